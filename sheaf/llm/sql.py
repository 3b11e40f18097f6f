"""DuckDB SQL for those queries of this subpackage that SQL can express."""

SQL = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda x:
                        substr('0000000100100011010001010110011110001001101010111100110111101111', strpos('0123456789abcdef', x)::INT * 4 - 3, 4)), '') AS bits,
                     max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
                   + 16 * substr(bits, (i * 5 + 1)::INT, 1)::INT + 8 * substr(bits, (i * 5 + 2)::INT, 1)::INT + 4 * substr(bits, (i * 5 + 3)::INT, 1)::INT
                   + 2 * substr(bits, (i * 5 + 4)::INT, 1)::INT + substr(bits, (i * 5 + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM b
    """,
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        totals AS (SELECT source, count(*) AS n FROM d WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source),
        lines AS (SELECT source, unnest(list_distinct(list_filter(ls, lambda x: trim(x) <> ''))) AS line FROM d WHERE source IS NOT NULL),
        bad AS (SELECT l.source, list(l.line) AS bl FROM (SELECT source, line, count(*) AS k FROM lines GROUP BY source, line) l
                JOIN totals t ON t.source = l.source WHERE l.k > 1 AND l.k / t.n > 0.1 GROUP BY l.source)
        SELECT d.doc_id,
               CASE WHEN b.bl IS NULL OR d.text IS NULL THEN d.text
                    ELSE coalesce(array_to_string(list_filter(d.ls, lambda x: NOT list_contains(b.bl, x)), chr(10)), '') END AS text,
               CASE WHEN b.bl IS NULL OR d.text IS NULL THEN 0
                    ELSE len(list_filter(d.ls, lambda x: list_contains(b.bl, x))) END::BIGINT AS n_dropped
        FROM d LEFT JOIN bad b ON b.source = d.source
    """,
    "op7_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, regexp_replace(regexp_replace(role, '([\\#])', '\\\1', 'g'), '<(/turn>)', '<\\\1', 'g') AS r2,
                     regexp_replace(regexp_replace(text, '([\\#])', '\\\1', 'g'), '<(/turn>)', '<\\\1', 'g') AS t2 FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length('### ' || replace(r2, ':', '\:') || ': ' || t2 || '</turn>' || chr(10)))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_mix": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source IS NULL, source) AS no FROM d GROUP BY source),
        s1 AS (SELECT *, ((no - 1) % 3)::INT AS kind, [5, 2, 1][((no - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * ss AS cap FROM s0),
        s2 AS (SELECT *, coalesce(sum(cap) OVER f, 0)::BIGINT AS caps, w + coalesce(sum(w) OVER g, 0)::BIGINT AS den, sum(ss) OVER ()::BIGINT AS total FROM s1
               WINDOW f AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (ORDER BY cap / w, no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        level AS (SELECT total - caps AS num, den FROM s2 WHERE w::HUGEINT * (total - caps) <= cap::HUGEINT * den ORDER BY cap / w, no LIMIT 1),
        s3 AS (SELECT s2.source, ss, no, kind, CASE WHEN w::HUGEINT * num > cap::HUGEINT * level.den THEN cap::DOUBLE ELSE (w * num)::DOUBLE / level.den::DOUBLE END AS target FROM s2, level),
        p AS (SELECT d.*, ss, no, kind, target, floor(target + 0.5)::BIGINT AS quota,
                     coalesce(sum(size) OVER (PARTITION BY no ORDER BY k, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
        c AS (SELECT *, before + e * ss AS start, greatest(least(size, quota - (before + e * ss)), 0)::BIGINT AS words FROM p, (SELECT unnest([0, 1, 2]) AS e)),
        q AS (SELECT *, CASE WHEN quota > 0 THEN start::DOUBLE / quota::DOUBLE ELSE 0e0 END AS share FROM c WHERE words > 0),
        t AS (SELECT *, CASE kind
                WHEN 0 THEN CASE WHEN share * 5e0 < 3e0 THEN 2e0 * (share * 5e0) / (6e0 + sqrt(36e0 + 0e0 * (share * 5e0)))
                                 ELSE 5e-1 + 2e0 * (share * 5e0 - 3e0) / (6e0 + sqrt(greatest(36e0 + -16e0 * (share * 5e0 - 3e0), 0e0))) END
                WHEN 1 THEN 2e0 * (share * 2e0) / (2e0 + sqrt(4e0 + 0e0 * (share * 2e0)))
                ELSE CASE WHEN share * 1e0 < 25e-2 THEN 2e0 * (share * 1e0) / (5e-1 + sqrt(25e-2 + 0e0 * (share * 1e0)))
                          ELSE 5e-1 + 2e0 * (share * 1e0 - 25e-2) / (5e-1 + sqrt(25e-2 + 8e0 * (share * 1e0 - 25e-2))) END END AS position FROM q),
        o AS (SELECT *, coalesce(sum(words) OVER (ORDER BY position, no, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM t),
        x AS (SELECT r, sum(words)::BIGINT AS taken, min("offset") AS first_offset FROM o GROUP BY r)
        SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_offset FROM p LEFT JOIN x ON p.r = x.r
    """,
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        langs AS (SELECT lang, sum(total)::BIGINT AS n, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
        full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.total, l.n AS ln, l.v FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
        p AS (SELECT *, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (ln + 2 * v) AS q FROM full_counts),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q),
        u AS (SELECT lang, source, 'pair' AS part, item, value FROM all_pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
