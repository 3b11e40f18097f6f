"""Mixing, divergence audit and whitening: against plain computations, and with odd rows."""

from collections import Counter, defaultdict
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import curriculum, divergence, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use."""
    own = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "one two", None, None, 7), (None, "xy " * 50_000, "en", "a", 1), (4, "same\nline\nhere", "en", "b", 1), (4, "same\nline\nhere", "en", "b", 1)]
    return spark.createDataFrame(own, DOCS).withColumns({c: F.lit("k") for c in ("row", "size", "no", "target", "number", "term", "count", "value", "rank", "id", "n", "key", "offset", "__part")})


# The mix.


def filled(sizes, weights, most=3):
    """Targets by sharing again and again what is above."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        den = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else left * w / den for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        above = {i for i, t in enumerate(target) if t > most * sizes[i]}
        if above <= capped:
            return target
        capped |= above


def test_times_invert_the_running_integral(spark):
    for schedule in [*curriculum.SCHEDULES, [(0.0, 0.0), (0.3, 4.0), (0.3001, 0.0), (1.0, 1.0)]]:
        shares = np.linspace(0, 0.999, 200)
        own = spark.createDataFrame([(float(s),) for s in shares], "s double")
        got = np.array([r[0] for r in own.select(curriculum.time_of(F.col("s"), schedule)).collect()])
        grid = np.linspace(0, 1, 400_001)
        rate = np.interp(grid, [t for t, _ in schedule], [w for _, w in schedule])
        running = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid))]
        assert np.allclose(np.interp(got, grid, running) / running[-1], shares, atol=2e-5)
        assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < 1


def test_schedules_give_whole_weights():
    assert curriculum.whole_weights(curriculum.SCHEDULES) == [5, 2, 1]
    assert curriculum.whole_weights([[(0, 1), (1, 2)], [(0, 1), (1, 1)]]) == [3, 2]
    for bad in ([(0, 1)], [(0.1, 1), (1, 1)], [(0, -1), (1, 1)], [(0, 0), (1, 0)], []):
        with pytest.raises(ValueError):
            curriculum.integral(bad)


def test_a_hot_source_and_small_ones(spark):
    sizes = {"hot": 3000, "s1": 40, "s2": 500, "s3": 7, "s4": 90, None: 11}
    docs = [(i, " ".join(["w"] * (1 + i % 5)), "en", s, 0) for s, n in sizes.items() for i in range(n)]
    mixed = curriculum.mix(spark.createDataFrame(docs, DOCS).repartition(7))
    copies = [r.asDict() for r in mixed.collect()]
    own = defaultdict(int)
    for _, text, _, s, _ in docs:
        own[s] += len(text.split())
    names = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    target = dict(zip(names, filled([own[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))]), strict=True))
    taken, by_document = Counter(), Counter()
    for c in copies:
        assert c["target"] == pytest.approx(target[c["source"]], rel=1e-12) and c["source_size"] == own[c["source"]]
        taken[c["source"]] += c["words"]
        by_document[c["row"]] += c["words"]
    assert {s: taken[s] for s in names} == {s: int(np.floor(t + 0.5)) for s, t in target.items()}
    assert len({c["row"] for c in copies}) == len(docs) and all(by_document[c["row"]] <= 3 * c["size"] for c in copies)
    # Offsets are the words before, in the order of positions.
    given = sorted((c for c in copies if c["words"]), key=lambda c: c["offset"])
    assert [c["offset"] for c in given] == np.r_[0, np.cumsum([c["words"] for c in given])[:-1]].tolist()
    assert all(a["position"] <= b["position"] for a, b in zip(given, given[1:], strict=False))
    # At any time each source has given what its schedule asks for.
    for time in (0.2, 0.5, 0.8):
        for k, s in enumerate(names):
            schedule = curriculum.SCHEDULES[k % 3]
            grid = np.linspace(0, time, 10_001)
            met = np.trapezoid(np.interp(grid, [t for t, _ in schedule], [w for _, w in schedule]), grid) / float(curriculum.integral(schedule)) * target[s]
            assert abs(sum(c["words"] for c in given if c["source"] == s and c["position"] < time) - met) <= 6
    again = curriculum.mix(spark.createDataFrame(docs, DOCS).repartition(3))
    key = lambda rows: Counter((r["id"], r["source"], r["epoch"], r["words"], r["position"], r["offset"]) for r in rows)
    assert key(again.collect()) == key(mixed.collect())


def test_mix_of_odd_rows(spark):
    got = curriculum.per_document(curriculum.mix(odd(spark))).collect()
    assert sorted((r["id"] if r["id"] is not None else -1, r["size"]) for r in got) == [(-1, 50_000), (1, 0), (2, 0), (3, 2), (4, 3), (4, 3)]
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    # 50,008 words: the largest source takes what the others' three copies leave.
    assert {r["source"]: r["target"] for r in got} == {"a": 50_008 - 18 - 6, "b": 18.0, None: 6.0}
    assert curriculum.mix(odd(spark).limit(0)).count() == 0
    assert [r["taken"] for r in curriculum.per_document(curriculum.mix(odd(spark).where("doc_id < 3"))).collect()] == [0, 0]


# The audit.


def plain_audit(docs, least=10, top=10):
    terms = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    out, langs = [], defaultdict(list)
    for text, lang, source in docs:
        langs[lang or ""].append((source or "", terms(text)))
    for lang, rows in langs.items():
        df, total, count = Counter(), Counter(), defaultdict(Counter)
        for source, ts in rows:
            df.update(set(ts))
            total.update(ts)
            count[source].update(ts)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)

        def prob(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, own = prob(total), {s: prob(count[s]) for s in {s for s, _ in rows}}
        for s, p in own.items():
            pairs = sorted(((-sum(f(p[t], o[t]) for t in kept), b.encode()) for b, o in own.items() if b != s))
            out += [(lang, s, "pair", b.decode(), -value, k + 1) for k, (value, b) in enumerate(pairs)]
            told = sorted((-f(p[t], q[t]), t.encode()) for t in kept if count[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -value, k + 1) for k, (value, t) in enumerate(told)]
    return sorted(out)


def test_audit_of_more_sources_than_a_block(spark):
    rng = np.random.default_rng(5)
    made = []
    for i in range(900):
        lang = ["xx", "yy"][i % 7 == 0]
        source = f"s{rng.integers(0, 150)}" if i % 3 else "hot"
        made.append((i, " ".join(f"T{chr(97 + w % 26)}{'é' * (w // 26)}, 9" for w in rng.zipf(1.5, 30) % 80), lang, source, 0))
    got = divergence.audit(spark.createDataFrame(made, DOCS).repartition(5))
    assert sorted(map(tuple, got.collect())) == plain_audit([(d[1], d[2], d[3]) for d in made])


def test_audit_of_odd_rows(spark):
    rows = odd(spark)
    assert sorted(map(tuple, divergence.audit(rows).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    plain = [(r["text"], r["lang"], r["source"]) for r in rows.collect()]
    assert sorted(map(tuple, divergence.audit(rows, least=1, top=1).collect())) == plain_audit(plain, 1, 1)
    assert divergence.audit(rows.limit(0)).count() == 0


def test_probabilities_beyond_longs(spark):
    own = spark.createDataFrame([(10**12, 3 * 10**13, 10**6)], "c long, n long, v long")
    assert own.select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (10**12 + 2) // (3 * 10**13 + 2 * 10**6)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    pieces = list(divergence.terms_of(b"Abc abc\xc3\xa9 x1y  abc" * 20 + b" z"))
    assert len(pieces) > 10 and Counter(t for p in pieces for t in p) == Counter({b"abc": 2, b"abc\xc3\xa9": 20, b"x": 20, b"y": 20, b"abcabc": 19, b"z": 1})


# Whitening.


def test_whitening_against_exact_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(i, [float(c) for c in x[0]]) for i in range(700, 1000)]
    full = np.array([r[1] for r in rows])
    got = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6))).toPandas()
    assert len(got) == 1000 * 32 and (got.n == 1000).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    w = [[int(c) for c in np.floor(64 * v) + 1_000_000] for v in full]
    s = [sum(c) for c in zip(*w, strict=True)]
    deviation = {i: sum((1000 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for (i, _), v in zip(rows, w, strict=True)}
    assert got.drop_duplicates("vec_id").set_index("vec_id").deviation.to_dict() == deviation
    centred = np.array([[1000 * c - t for c, t in zip(v, s, strict=True)] for v in w], dtype=float) / 1000
    values, vectors = np.linalg.eigh(centred.T @ centred / 1000)
    want = centred @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-8)
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values[::-1][:32] / values.sum(), rtol=1e-10)


def test_states_merge_like_one():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 5)) * 1000).astype(np.int64) + 10**6
    one = whitening.state_of(x)
    parts = None
    for k in (0, 1, 7, 150):
        parts = whitening.merged(parts, whitening.state_of(x[k : {0: 1, 1: 7, 7: 150, 150: 300}[k]]))
    assert parts.n == 300 and (parts.sums == one.sums).all() and np.allclose(parts.scatter, one.scatter, rtol=1e-12)
    big = np.full((4, 2), 2**52, dtype=np.int64)
    assert whitening.state_of(big).sums.tolist() == [2**54, 2**54]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (None, [1e300, -1e300]), (8, [1.0, 2.0, 3.0])]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("k") for c in ("id", "n", "vector", "whitened", "state")})
    white = {(r["vec_id"], len(r["whitened"])): r for r in whitening.whiten(own).collect()}
    # Two dimensions, four rows; three dimensions, one row, which has no variance.
    assert {k[0] for k in white} == {6, 7, None, 8} and white[8, 0]["n"] == 1
    assert all(r["n"] == 4 for k, r in white.items() if k[0] != 8)
    assert whitening.by_component(whitening.whiten(own)).where("vec_id = 8").count() == 0
    assert whitening.whiten(own.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 3) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.by_component(whitening.whiten(same)).count() == 0


def test_whitening_query(spark, sf):
    out = queries.op13_whitening(spark, sf)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.where("identity_error > 1e-4 or deviation is null").count() == 0 and out.count() == 32 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
