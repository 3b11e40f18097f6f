"""The training-data operators: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import itertools
import json
import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import ann, bpe, chat, decontam, fmindex, jaccard, langid, linededup, pii, quality, queries, sql, warc
from sheaf.llm.components import components
from sheaf.llm.words import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents embeddings pages benchmark labels conversations".split()
ODD = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "one two", None, None, 7), (None, "x" * 100_000, "en", "a", 1), (4, "same\nline\nhere", "en", "a", 1), (4, "same\nline\nhere", "en", "a", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use."""
    return spark.createDataFrame(ODD, DOCS).withColumns({"host": F.lit("h"), "score": F.lit(1), "key": F.lit("k"), "cls": F.lit("c")})


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    own = frame[columns].astype(object)
    return columns, sorted(map(tuple, own.where(own.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_matches_sql(spark, db, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(db.execute(sql.SQL[name]).df())


# Quality.


def test_quality_on_held_out_rows(spark, sf):
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    known = labels.where(F.col("doc_id") % 3 != 0)
    judged = quality.classify(docs, known).join(labels.where(F.col("doc_id") % 3 == 0), "doc_id").select("judged.*", labels["quality"].alias("q"), labels["toxic"].alias("t")).collect()
    assert np.mean([(r["quality"] >= 0.5) == bool(r["q"]) for r in judged]) >= 0.97
    assert np.mean([(r["toxic"] >= 0.5) == bool(r["t"]) for r in judged]) >= 0.95


def test_sparse_sites_shrink(spark):
    scores = [("big", "p", 3.0, -3.0)] * 200 + [("bad", "p", -3.0, -3.0)] * 200 + [("few", "p", -3.0, -3.0)] * 2
    frame = spark.createDataFrame(scores, "host string, path string, quality double, toxic double")
    known = quality.sites(frame)
    found = {r["host"]: r["x"] for r in known.rows.select("host", known.shift("quality", F.lit(1 / (1 + math.exp(3)))).alias("x")).collect()}
    assert found["bad"] < -1 and abs(found["few"]) < abs(found["bad"])


def test_posteriors_against_brute_force(spark):
    """Posteriors of all rows but a row's own, computed row by row in Python."""
    random = np.random.default_rng(8)
    data = [(int(i), f"t{i}", ["a", "b", None][int(random.integers(3))], ["x", None][int(random.integers(2))]) for i in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    logits = {i: float(random.normal() * 2) for i, *_ in data}
    scored = spark.createDataFrame([(s, p, logits[i], -logits[i]) for i, _, s, p in data], "host string, path string, quality double, toxic double")
    known = quality.sites(scored)
    p = {i: 1 / (1 + math.exp(-logits[i])) for i in logits}
    prior = np.mean(list(p.values()))
    odds = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    own = 1 / (1 + F.exp(-F.col("quality")))
    joined = scored.join(known.rows.withColumnsRenamed({"host": "h", "path": "q"}), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    found = sorted(r["x"] for r in joined.select(known.shift("quality", own).alias("x")).collect())
    expected = []
    for i, _, s, l in data:
        h = [p[j] for j, _, s2, _ in data if s2 == s and j != i]
        q = [p[j] for j, _, s2, l2 in data if (s2, l2) == (s, l) and j != i]
        k, kp = known.host_strength["quality"], known.path_strength["quality"]
        host = (sum(h) + k * prior) / (len(h) + k)
        expected.append(odds((sum(q) + kp * host) / (len(q) + kp)) - odds(prior))
    assert np.allclose(found, sorted(expected), atol=1e-9)


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, none).count() == len(ODD)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd, labels)
    assert out.columns == [*odd.columns, "judged"] and out.count() == len(ODD)
    assert quality.classify(odd.limit(0), labels).count() == 0


# BPE.


def test_bpe_is_the_librarys(sf):
    from tokenizers import Tokenizer

    own, library = bpe.Bpe(bpe.word_vocabulary()), Tokenizer.from_file(bpe.word_vocabulary())
    # Each code point beside letters, symbols, numbers and itself: each may be split from another.
    every = [f"a{chr(c)}b!{chr(c)}1{chr(c)}{chr(c)}!" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 100_000):
        some = every[at : at + 100_000]
        for text, known in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
            assert bpe.unpacked(own.packed(text)) == known.ids, hex(ord(text[1]))
    texts = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    texts += ["", " ", "a<|endoftext|>B <|startoftext|>", "I'LL we've 12 ½ Ⅷ", "Σας ΟΔΟΣ İ ß", "é É 日本 👍🏽", "x\x1cy z w", "a" * 500, "!?" * 400, "the​the", "\x00\x01", "</w>", "ab" * 3000]
    random = np.random.default_rng(0)
    few = ["a", "!", "1", " ", "é", "\U00012550", "\U000114ab", "\U00011DE0", "\U0001246F", "\U00012475", "\U00016FF4", "½", "日", "\u0558"]
    texts += ["".join(random.choice(few, random.integers(1, 9))) for _ in range(200_000)]
    texts += ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz'"), random.integers(1, 25))) for _ in range(3000)]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = bpe.unpacked(own.packed(text))
        assert ids == known.ids, text[:80]
        assert own.decode(ids) == library.decode(known.ids, skip_special_tokens=False)


def test_bpe_query(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_vocabulary())
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    found = queries.op2_bpe(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, odd):
    made = bpe.encode(odd)
    assert made.columns == [*odd.columns, "ids"] and made.count() == len(ODD)
    assert {r["doc_id"]: len(r["ids"]) for r in made.where("doc_id in (1, 2)").collect()} == {1: 0, 2: 0}
    assert bpe.decode(made.where("doc_id = 3")).first()["decoded"] == "one</w> two</w>"
    assert bpe.encode(odd.limit(0)).count() == 0


# Personal data.


def test_surrogates(spark):
    said = "Mr. John Smith (j.smith@corp.example) paid 4111 1111 1111 1111 from 10.1.2.3; call +1 (017) 555-7713. Frau Anna Smith: DE89 3704 0044 0532 0130 00, г-жа Анна Петрова. token " + "ab12" * 10
    again = "Mr. Smith wrote J.Smith@corp.example, card 4111111111111111, phone +1 017 555 7713"
    frame = spark.createDataFrame([(1, said), (2, again), (3, None), (4, ""), (5, "no data 12"), (None, said), (2, again)], "doc_id long, text string")
    out = [(r["doc_id"], r["text"], r["n"]) for r in pii.pseudonymise(frame, "k", counted="n").collect()]
    assert len(out) == 7
    new = {d: t for d, t, _ in out}
    assert new[3] is None and new[4] == "" and new[5] == "no data 12" and new[None] == new[1]
    for gone in ("John", "Smith", "smith", "4111", "10.1.2.3", "555-7713", "DE89", "Анна", "Петрова", "ab12ab12"):
        assert gone not in new[1] and gone not in new[2]
    m = re.match(r"Mr\. (\w+) (\w+) \((\S+@\S+)\) paid (\d{4} \d{4} \d{4} \d{4}) from (\d+\.\d+\.\d+\.\d+); call (\+1 \(\d{3}\) \d{3}-\d{4})\. Frau (\w+) (\w+): (DE\d\d(?: \d{4}){4} \d\d), г-жа (\S+) (\S+)\. token ([0-9a-f]{40})$", new[1])
    assert m, new[1]
    given, family, email, card, _, phone, woman, family2, iban, cyrillic, _, _ = m.groups()
    assert given in pii.GIVEN["latin", "m"] and woman in pii.GIVEN["latin", "f"] and cyrillic in pii.GIVEN["cyrillic", "f"]
    assert family == family2
    assert f"Mr. {family} wrote {email}, card {card.replace(' ', '')}" in new[2]
    assert re.sub(r"\D", "", phone) in re.sub(r"\D", "", new[2])
    digits = [int(x) for x in card.replace(" ", "")][::-1]
    assert sum(digits[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in digits[1::2]) % 10
    moved = iban.replace(" ", "")[4:] + iban[:4]
    assert int("".join(str(int(x, 36)) for x in moved)) % 97 == 1
    assert pii.pseudonymise(frame.limit(0), "k").count() == 0


def test_surrogates_are_distinct(spark):
    """More names than there are surrogates at the first attempt, so that collisions are met and settled."""
    random = np.random.default_rng(1)
    names = sorted({"".join(random.choice(list("abcdefghij"), 5)).capitalize() for _ in range(300)})
    frame = spark.createDataFrame([(i, f"Mr. {n} Same and 1.2.{i % 200}.{i // 200}") for i, n in enumerate(names)], "doc_id long, text string")
    found = pii.held(frame).where("__p_has").select(F.explode(F.flatten(F.transform("__p_found", lambda e: e["units"]))).alias("u")).select("u.*")
    known = pii.surrogates(found, "k").collect()
    per = defaultdict(list)
    for r in known:
        per[r["kind"]].append((r["value"], r["new"]))
    assert len(per["given_latin"]) == len(names)
    for pairs in per.values():
        assert len({n for _, n in pairs}) == len(pairs)
        assert not {n for _, n in pairs} & {v for v, _ in pairs}
    out = pii.pseudonymise(frame, "k").collect()
    assert len({r["text"].split()[1] for r in out}) == len(names)


def test_known_names_go_wherever_they_stand(spark):
    texts = [
        "Mr. John Smith met Dr. Jane Roe. John Smith left; SMITH and Jane stayed. Johnson and Smithers did not come. Mr. Smith slept.",
        "key " + "abcdef" * 6 + "ab end",
        "key " + "abcdef" * 6 + "ab end 7",
        "Mrs. Anna-Maria O'Brien, then O'Brien, then Anna",
        "a \ufdd0 mark, Mr. Smith and 10.0.0.9",
        "Dr. Арам Петров и г-жа Петрова; Mr. Արամ Պետրոսյան",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame, "k").collect()}
    m = re.match(r"Mr\. (\S+) (\S+) met Dr\. (\S+) (\S+)\. (\S+) (\S+) left; (\S+) and (\S+) stayed\. Johnson and Smithers did not come\. Mr\. (\S+) slept\.$", new[0])
    assert m, new[0]
    john, smith, jane, roe, john2, smith2, smith3, jane2, smith4 = m.groups()
    assert john == john2 and smith == smith2 == smith4 and smith3 == smith.upper() and jane == jane2 and len({john, smith, jane, roe, "John", "Smith", "Jane", "Roe"}) == 8
    assert new[1][:42] == new[2][:42] != texts[1][:42]
    assert not re.search("Anna|Maria|Brien", new[3]) and new[3].count(new[3].split()[2].rstrip(",")) == 2
    assert "\ufdd0" in new[4] and f"Mr. {smith} and 10." in new[4] and "10.0.0.9" not in new[4]
    assert not re.search("Арам|Петров|Արամ|Պետրոսյան", new[5]) and re.search("[\u0530-\u058f]{4,}", new[5]) and re.search("г-жа \\w+(?:ва|на|ая)\\b", new[5])
    assert pii.pseudonymise(frame, "other").where("doc_id = 0").first()["text"] != new[0]


def test_one_name_is_one_person(spark):
    """80 given names behind titles of two kinds stay 80, and a name is the same behind every title."""
    names = ["".join(p) for p in itertools.product("BCDFGHJK", "aeiou", ["lan", "ron"])]
    texts = [f"{'Mr.' if i % 2 else 'Dr.'} {n} Kim" for i, n in enumerate(names)] + ["Dr. Alex Kim and Mr. Alex Kim", "Mrs. Robin Kim, Mrs. Robin Lee and Mr. Robin Roe", "Dr. Sarah Kim, Dr. Thomas Kim"]
    new = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert len({t.split()[1] for t in new[:80]}) == 80 and len({t.split()[2] for t in new[:80]}) == 1
    one = new[80].split()
    assert one[1:3] == one[5:7] and one[1] != "Alex"
    # Most titles say that Robin is a woman; lists tell what no title does.
    robin = re.findall(r"M(?:rs|r)\. (\w+)", new[81])
    assert len(set(robin)) == 1
    women, men = ({w.lower() for w in pii.GIVEN["latin", g]} for g in "fm")
    assert any(robin[0].lower().startswith(w) for w in women) and any(new[82].split()[1].lower().startswith(w) for w in women) and any(new[82].split(", ")[1].split()[1].lower().startswith(w) for w in men)


def test_surrogates_by_brute_force(spark, monkeypatch):
    """The rounds of assignment, unit by unit in a plain loop."""
    monkeypatch.setattr(pii, "GIVEN", {k: v[:6] for k, v in pii.GIVEN.items()})
    monkeypatch.setattr(pii, "FORMATTED", 3)
    units = [("given_latin", n, s) for n in ("Ada", "Ben", "Cleo", "Dan", "Eli", "Fay", "Adrian", "Adele") for s in ("m", "f", "f")] + [("family_n_latin", n, "") for n in ("Ada", "Alderberg", "Lee")] + [("ssn", f"{i:03d}00{i:04d}", "") for i in range(30)]
    frame = spark.createDataFrame(units, "kind string, value string, said string")
    got = {(r["kind"], r["value"]): r["new"] for r in pii.surrogates(frame, "k").collect()}
    space = lambda kind: "name" if kind.startswith(("given", "family")) else kind
    todo = sorted({(v, k) for k, v, _ in units})
    taken, attempt, want = {(space(k), v) for v, k in todo}, 0, {}
    while todo:
        rows = [(k, v, "f" if k == "given_latin" else "") for v, k in todo]
        drawn = {(r["kind"], r["value"]): r["new"] for r in pii._drawn(spark.createDataFrame(rows, "kind string, value string, gender string"), attempt, "k").collect()}
        # Surrogates of a round are given out together, those of earlier rounds are taken.
        given = set()
        for v, k in todo:
            place = (space(k), drawn[k, v])
            if place not in taken and place not in given:
                want[k, v] = drawn[k, v]
                given.add(place)
        taken |= given
        todo, attempt = [(v, k) for v, k in todo if (k, v) not in want], attempt + 1
    assert got == want and len({(space(k), n) for (k, _), n in got.items()}) == len(got)


def test_forms_without_caps(spark):
    said = [
        "0a" * 40, "sk-" + "Ab1" * 40, "a" * 90 + "." + "b" * 70 + "@ml.net", "2001:db8:85a3::8a2e:370:7334", "fe80::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "github_pat_11ABCDEFG0" + "a1_B2" * 12, "de89 3704 0044 0532 0130 00", "gb29nwbk60161331926819",
        "Mr.  John  Smith", "xoxb-123456789012-abcdefghijkl", "AKIA" + "B" * 16,
    ]
    plain = ["at 12:30:45 on", "std::vector and a::b", "mp34 with some word after", "skrupellosigkeiten und anderes", "sk- and ghp_ alone", "ratio 1::", "ab:cd:ef"]
    frame = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(said)] + [(100 + i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame, "k").collect()}
    for i, t in enumerate(said):
        assert not set(re.findall(r"[^\W_]{5,}", t)) & set(re.findall(r"[^\W_]+", new[i])), (t, new[i])
        assert new[i].startswith("x ") and new[i].endswith(" y")
    assert [new[100 + i] for i in range(len(plain))] == plain
    assert re.fullmatch(r"x [0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} y", new[3]) and re.fullmatch(r"x Mr\.  \w+  \w+ y", new[9])
    iban = new[7][2:-2].replace(" ", "").upper()
    assert re.fullmatch(r"de\d\d( \d{4}){4} \d\d", new[7][2:-2]) and int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def test_every_pattern_has_its_hint(spark):
    said = ["a.b@c.example", "0" * 32, "abcdef" * 6, "sk-" + "A" * 16, "AKIA" + "B" * 16, "DE89 3704 0044 0532 0130 00", "10.1.2.3", "4111111111111111", "123-45-6789", "+49 30 1234567", "(030) 123-4567", "Mr. Smith", "Frau Anna Roe", "г-н Петров"]
    frame = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(said)] + [(99, "Nothing Of That Kind here")], "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame, "k").collect()}
    assert all(t not in new[i] and new[i].startswith("x ") and new[i].endswith(" y") for i, t in enumerate(said)) and new[99] == "Nothing Of That Kind here"


def test_surrogates_odd_rows(spark, odd):
    out = pii.pseudonymise(odd, "k", counted="score")
    assert set(out.columns) == set(odd.columns) and out.count() == len(ODD) and out.agg(F.sum("score")).first()[0] == 0
    long = spark.createDataFrame([(1, "Mr. Smith and 10.1.2.3, " * 5000)], "doc_id long, text string")
    row = pii.pseudonymise(long, "k", counted="n").first()
    assert row["n"] == 10_000 and len(set(row["text"].split(", "))) == 2


def test_full_formats_still_give_distinct_surrogates(spark, monkeypatch):
    monkeypatch.setattr(pii, "FORMATTED", 2)
    frame = spark.createDataFrame([(i, f"+1 {i // 100:02d} {i % 100:02d}") for i in range(9_000)], "doc_id long, text string").coalesce(1)
    out = [r["text"] for r in pii.pseudonymise(frame, "k").collect()]
    assert len(set(out)) == 9_000


# WARC.


def test_warc_round_trip(spark):
    same = "<p>é</p>\r\n\r\nWARC/1.1\r\n"
    pages = spark.createDataFrame([(1, "http://User@WWW.Example.com:80/a?b#c", same), (5, "https://example.com/x y", same), (3, None, None), (2, "http://example.com", ""), (9, "ftp://a.b/c", "z" * 300_000), (None, "http://example.com/n", same)], "page_id long, url string, html string")
    folder, captures, shards = warc.archive(spark, pages)
    assert captures.count() == 6
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    back = {r["page_id"]: r for r in warc.fetch(warc.resolve(keys, shards, f"{folder}/index"), f"{folder}/archives").collect()}
    assert len(back) == 6
    texts = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for i, r in back.items():
        assert r["payload_bytes"] == len(texts[i]) and r["payload_digest"] == warc.base32(hashlib.sha1(texts[i]).digest())
        assert r["payload"] == (texts[i] if r["record_type"] == "response" else None)
    assert {i: r["refers_to"] for i, r in back.items()} == {1: 5, None: 5, 5: None, 3: None, 2: 3, 9: None}
    assert one(spark, warc.url_key(F.lit("http://User@WWW.Example.com:80/a?b#c"))) == "com,example,www)/a?b"
    missing = spark.createDataFrame([("com,none)/",)], "key string")
    assert warc.resolve(missing, shards, f"{folder}/index").count() == 0


def test_warc_index_over_blocks_and_shards(spark, tmp_path):
    frame = spark.range(5000).select(F.format_string("k%03d", F.col("id") % 40).alias("key"), "id", F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"))
    folder = f"file://{tmp_path}/index"
    shards = warc.build_index(frame, folder, block_lines=50)
    found = warc.resolve(frame.select("key"), shards, folder)
    assert found.count() == 5000 and found.select("id").distinct().count() == 5000


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder, captures, shards = warc.archive(spark, pages)
    assert captures.count() == 0 and warc.resolve(captures, shards, f"{folder}/index").count() == 0


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# Line dedup.


def test_line_dedup(spark, odd):
    pages_ = [(i, f"menu\nown {i}\n\nmenu", "a") for i in range(10)] + [(90, "menu\nx", "b"), (91, None, "a"), (92, "menu", None), (93, "menu", "a")]
    frame = spark.createDataFrame(pages_, "doc_id long, text string, source string")
    out = {r["doc_id"]: (r["text"], r["n"]) for r in linededup.drop_boilerplate(frame, dropped="n").collect()}
    assert out[3] == ("own 3\n", 2) and out[90] == ("menu\nx", 0) and out[91] == (None, 0) and out[92] == ("menu", 0) and out[93] == ("", 1)
    assert linededup.drop_boilerplate(odd).columns == odd.columns
    assert linededup.drop_boilerplate(odd).count() == len(ODD) and linededup.drop_boilerplate(odd.limit(0)).count() == 0


# Language.


def test_language_on_held_out_rows(spark):
    out = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_backpropagation_through_time():
    random = np.random.default_rng(0)
    net = langid.Network.new(["a", "b"], units=3)
    for part in (net.ahead, net.back):
        part.inputs, part.recurrent = part.inputs.astype(np.float64), part.recurrent.astype(np.float64)
    gru, x = net.ahead, random.integers(0, 4, (6, 5))
    aim = random.normal(size=(6, 3, 5))
    kept = []
    gru.forward(x, kept)
    inputs, recurrent = gru.backward(x, kept, aim)
    loss = lambda: float((gru.forward(x).astype(np.float64) * aim).sum())
    for weights, gradient in ((gru.inputs, inputs), (gru.recurrent, recurrent)):
        for at in [(0, 1), (4, 2), (7, 0), (8, 1)]:
            weights[at] += 1e-3
            up = loss()
            weights[at] -= 2e-3
            down = loss()
            weights[at] += 1e-3
            assert abs((up - down) / 2e-3 - gradient[at]) < 2e-2 * max(1, abs(gradient[at]))


def test_documents_pool_positions():
    """Pooled probabilities of whole texts against a plain loop over their segments."""
    random = np.random.default_rng(1)
    net = langid.Network.new(["a", "b", "c"])
    net.out = random.normal(size=net.out.shape).astype(np.float32)
    texts = ["", None, "abc", "é" * 100, "x y " * 300, "z" * langid.SEGMENT]
    for text, found in zip(texts, net.documents(texts), strict=True):
        raw = (text or "").encode()
        total = np.zeros(3)
        for at in range(0, len(raw), langid.SEGMENT):
            own = np.full((langid.SEGMENT, 1), langid.NONE, np.int16)
            part = np.frombuffer(raw[at : at + langid.SEGMENT], np.uint8)
            own[: len(part), 0] = part
            total += net.positions(own)[0][: len(part), :, 0].sum(0)
        assert np.allclose(found, total / max(1, len(raw)), atol=1e-4)


def test_a_null_id_is_not_held_out(spark):
    assert spark.range(1).select(F.coalesce(F.crc32(F.lit(None).cast("string")) % 4 == 2, F.lit(False)).alias("h")).first()["h"] is False


def test_language_odd_rows(spark, odd):
    net = langid.Network.new(["en", "fr"])
    out = {r["doc_id"]: r["p"] for r in odd.select("doc_id", langid.predict(odd, net).alias("p")).collect()}
    assert out[1]["lang"] == "und" and out[2]["lang"] == "und" and out[3]["lang"] in ("en", "fr")
    assert langid.fit(odd.limit(0)) is None
    assert odd.select(langid.predict(odd, None).alias("p")).where("p.lang = 'und'").count() == len(ODD)


# Chat.

LAYOUTS = [
    ({"prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"output": "b", "instruction": "a", "input": None}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "c", "output": "b"}, [("user", "a"), ("user", "c"), ("assistant", "b")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}, {"content": "é\n", "role": "assistant"}]}, [("system", "s"), ("user", ""), ("assistant", "é\n")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversation": {"messages": [{"role": "user", "content": "a"}, {"role": "assistant"}]}}, [("user", "a"), ("assistant", "")]),
    ({"messages": [{"author": {"role": "user"}, "content": {"text": "x [1] {y}"}}, {"content": {"text": "b"}, "author": {"role": "assistant"}}]}, [("user", "x [1] {y}"), ("assistant", "b")]),
    ({"data": {"completion": "b", "prompt": "a"}}, [("user", "a"), ("assistant", "b")]),
]


def test_chat_layouts(spark):
    data = [(i, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(90, '{"x": 1}'), (91, "no json"), (92, None), (93, '{"messages": []}')]
    frame = spark.createDataFrame(data, "key long, record string")
    turns = chat.canonical_turns(frame)
    found = defaultdict(list)
    for r in turns.orderBy("key", "pos").collect():
        found[r["key"]].append((r["role"], r["text"]))
    assert found == {i: t for i, (_, t) in enumerate(LAYOUTS)}
    assert {r["paths"] for r in chat.unknown_layouts(frame).collect()} == {"x", None, "messages[]"}


def test_chat_escapes(spark):
    nasty = ["\\### Assistant: </turn> ok", "###", "####", "<</turn>", "</turn>\n### user: x", "\\", "\\\\", "#\\##", "<\\/turn>", "", "a: b", "é\n\n</turn", ">"]
    frame = spark.createDataFrame([(1, i, "assistant" if i % 2 else "a: \\b", t, "x") for i, t in enumerate(nasty)], "key long, pos long, role string, text string, layout string")
    made = chat.format_turns(frame)
    row = made.first()
    assert row["formatted"].count("</turn>") == len(nasty) == row["formatted"].count("###")

    def plainly(t):
        return "".join("\\" + x if x in "\\#" else x for x in t).replace("</turn>", "<\\/turn>")

    role = lambda i: "assistant" if i % 2 else "a\\: \\\\b"
    assert row["formatted"] == "".join(f"### {role(i)}: {plainly(t)}</turn>\n" for i, t in enumerate(nasty))
    back = chat.read_back(made).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [("assistant" if i % 2 else "a: \\b", t) for i, t in enumerate(nasty)]
    assert list(back["learned"]) == [t for i, t in enumerate(nasty) if i % 2 and t]
    for span in row["loss"]:
        assert row["formatted"][span["turn"] :].startswith("### ")


def test_chat_odd_rows(spark):
    turns = spark.createDataFrame([(None, 1, "user", "a", "x"), (None, 2, "assistant", "b", "x"), (1, None, "user", "a", "x"), (1, None, "user", "a", "x"), (2, 5, "", "", "x")], "key long, pos long, role string, text string, layout string").withColumns({"t": F.lit(1), "at": F.lit(2)})
    back = {r["key"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("user", "a"), ("assistant", "b")] and list(back[None]["learned"]) == ["b"]
    assert len(back[1]["turns"]) == 2 and [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")]
    assert chat.format_turns(turns.limit(0)).count() == 0
    many = spark.range(30_000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.read_back(chat.format_turns(many)).first()
    assert [int(t["text"]) for t in row["turns"]] == list(range(30_000)) and [int(x) for x in row["learned"]] == list(range(1, 30_000, 2))


# Nearest neighbours.


def exact(data, asked, k):
    out = []
    for q, v in data:
        if not asked(q):
            continue
        found = sorted((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in data if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def test_ann_against_brute_force(spark):
    random = np.random.default_rng(2)
    data = [(i, (random.normal(size=8) + (i % 5) * 3).round(3)) for i in range(700)]
    data += [(1000 + i, data[0][1]) for i in range(30)] + [(2000 + i, data[1][1] * 2) for i in range(3)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in data] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8), (None, [1.0] * 8), (5004, [1.0]), (5005, [float("inf")] * 8)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(frame, F.col("id") % 50 == 0).collect())
    expected = sorted(exact(data, lambda i: i % 50 == 0, 5))
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _, _ in expected]
    assert np.allclose([x[3] for x in got], [x[3] for x in expected], atol=1e-12)
    copies = [x[2] for x in got if x[0] == 1000]
    assert copies == [0, 1001, 1002, 1003, 1004]
    short = ann.search(frame.unionByName(spark.createDataFrame([(5006, [2.0])], frame.schema)), F.col("id") == 5004).collect()
    assert [(r["vec_id"], r["score"]) for r in short] == [(5006, 1.0)]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], frame.schema)
    assert [(r["vec_id"], round(r["score"], 3)) for r in sorted(ann.search(twice, F.col("id") == 0).collect(), key=lambda r: r["rank"])] == [(1, 0.995), (2, 0.707)]
    few = ann.search(frame.where("vec_id < 3"), F.col("id") == 0).collect()
    assert len(few) == 2
    assert ann.search(frame.limit(0), F.col("id") == 0).count() == 0


def test_hilbert_steps_are_short():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = points[np.argsort(ann.hilbert(points, 3))]
    assert sorted(ann.hilbert(points, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# Decontamination.


def test_fm_index_against_search():
    random = np.random.default_rng(3)
    for size, sigma in ((1, 3), (50, 2), (400, 4), (3000, 30)):
        t = random.integers(1, sigma + 1, size)
        t[size // 2 :] = t[: size - size // 2]  # long repeats
        index = fmindex.FmIndex(t, sample=7)
        phrases = [t[s : s + n] for s, n in zip(random.integers(0, size, 40), random.integers(1, 11, 40), strict=True)] + [random.integers(1, sigma + 2, 4) for _ in range(20)]
        padded = np.zeros((len(phrases), 10), np.int64)
        for row, p in zip(padded, phrases, strict=True):
            row[10 - len(p) :] = p
        low, high = index.search(padded, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high, strict=True):
            expected = [i for i in range(size - len(p) + 1) if (t[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), decontam.digest(list(found)), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_contamination_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "SHARD", 64)
    random = np.random.default_rng(4)
    vocabulary = ["ab", "cd", "Ef", "gh", "é", "ij", "x1"]
    text = lambda n: " ".join(random.choice(vocabulary, n))
    items = [(i, text(14)) for i in range(12)] + [(20, "ab cd"), (21, ""), (22, None), (23, "zz yy"), (24, text(10))]
    docs = [(i, f"{text(int(random.integers(0, 60)))} {items[i % 12][1][5:]}, {text(5)}") for i in range(40)] + [(90, None), (91, ""), (92, "ab!CD"), (93, "zz  yy")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.digests(decontam.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute_contamination(docs, items)
    clean = decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert len(left) == len(docs) and not any(x[4] for x in brute_contamination(left, items).values())


def test_contamination_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "line here"), (None, "same line")], "item_id long, text string")
    for b in (none, items):
        out = decontam.decontaminate(odd, b)
        assert out.columns == odd.columns and out.count() == len(ODD)
    assert decontam.contamination(odd.limit(0), items).count() == 0


# Jaccard.


def brute_groups(docs):
    classes = defaultdict(list)
    for i, t in docs:
        w = words(t)
        key = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else ("text", t)
        classes[key].append(i)
    sets = list(classes)
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if isinstance(sets[a], frozenset) and isinstance(sets[b], frozenset):
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k in range(len(sets)):
        least[find(k)] = min(least[find(k)], *classes[sets[k]])
    return {i: (least[find(k)], links[k], min(classes[s])) for k, s in enumerate(sets) for i in classes[s]}


@pytest.mark.parametrize("chunk", [256, 8])
def test_jaccard_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    random = np.random.default_rng(5)
    base = [" ".join(random.choice(["a", "b", "c", "d", "e", "f", "g"], 120)) for _ in range(12)]
    docs = []
    for i in range(110):
        w = base[i % 12].split()
        for at in random.integers(0, len(w), int(random.integers(0, 4))):
            w[at] = f"n{random.integers(0, 3)}"
        docs.append((i, " ".join(w)))
    docs += [(200, "one two"), (201, "One, two!"), (202, ""), (203, ""), (204, "!!"), (205, docs[3][1].upper()), (206, docs[3][1])]
    frame = spark.createDataFrame([*docs, (300, None)], "doc_id long, text string")
    found = {r["id"]: (r["group"], r["links"], r["copy_of"]) for r in jaccard.join(frame).collect()}
    assert found == brute_groups(docs)
    kept = jaccard.keep_one(frame)
    groups = brute_groups(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for g, _, _ in groups.values()} | {300})


def test_jaccard_odd_rows(spark, odd):
    out = jaccard.keep_one(odd)
    assert out.columns == odd.columns and out.count() == len(ODD) - 1
    assert jaccard.keep_one(odd.limit(0)).count() == 0 and jaccard.join(odd.limit(0)).count() == 0


def test_tolerance_is_the_posterior():
    least = jaccard.least_matches(0.8, 1e-7)
    random = np.random.default_rng(6)
    s = random.random(2_000_000)
    m = random.binomial(16, s + (1 - s) / 256)
    few = s[m < least[16]]
    assert (few >= 0.8).mean() < 1e-5 and list(least.values()) == sorted(least.values())


def test_components(spark):
    edges = [(f"{a:03d}", f"{a + 1:03d}") for a in range(0, 60)] + [("900", "901"), ("905", "905"), ("902", "900")]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(found.values()) == {"000", "900"} and found["060"] == "000" and found["902"] == "900" and "905" not in found


def test_many_equal_cosines_are_cut_by_id():
    random = np.random.default_rng(0)
    base = random.normal(size=8)
    x = np.vstack([random.normal(size=(2000, 8)), [base * 2.0**i for i in range(40)]])
    ids = [[5000 + i] for i in range(2000)] + [[100 - i] for i in range(40)]
    found = ann._best(["q"], base[None, :], x, ids, 5).to_pylist()
    assert [r["id"] for r in found] == [61, 62, 63, 64, 65, 66]


def test_string_ids_and_copies_of_one_text(spark):
    """Ids that are no numbers, and a text that a third of all rows hold."""
    words_ = [f"w{i}" for i in range(60)]
    hot = " ".join(words_)
    near = " ".join([*words_[:57], "x", "y", "z"])
    made = [(f"h{i}", hot) for i in range(40)] + [("n1", near), ("a0", hot), (None, near)] + [(f"o{i}", " ".join(f"{c}{i}" for c in "abcdefghij")) for i in range(40)]
    frame = spark.createDataFrame(made, "doc_id string, text string").repartition(6)
    groups = defaultdict(set)
    for r in jaccard.join(frame).collect():
        groups[r["group"]].add(r["id"])
    assert groups["a0"] == {*(f"h{i}" for i in range(40)), "a0", "n1", None} and len(groups) == 41
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(frame).collect()) == sorted(["a0", *(f"o{i}" for i in range(40))])


def test_lines_by_the_share_of_a_hosts_pages(spark):
    made = [(i, f"own {i}\nevery page\n" + ("some" if i < 3 else "x"), "a") for i in range(20)] + [(100 + i, f"only {i}\ntwice", "b") for i in range(2)] + [(200, "alone", "c"), (201, "n", None)]
    new = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(spark.createDataFrame(made, "doc_id long, text string, source string"), max_ratio=0.15).collect()}
    # 20 of 20, 17 of 20; 3 of 20 are not more than the ratio.
    assert new[0] == "own 0\nsome" and new[5] == "own 5" and new[100] == "only 0" and new[200] == "alone" and new[201] == "n"
