"""How far the sources of a language are apart, by smoothed term probabilities, in whole numbers.

For two sources s, t of a language with V kept terms the measure is a sum over all kept
terms. Most terms are in few sources, so it starts at V times the value of two zero
counts, and only what the postings of a term change is added:

    sum of f(p, q) = V f(p0, q0)
                   + terms of s:    f(p, q0) - f(p0, q0)
                   + terms of t:    f(p0, q) - f(p0, q0)
                   + terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The middle parts hang on a source's counts alone, so equal counts go as one; the last
is read off the postings of each term, in blocks of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise, small_batches
from sheaf.operators.records import number_sections

#: A term is kept in a language with this many documents that hold it.
LEAST_DOCS = 10
#: Terms told of each source.
TOP = 10
#: Probabilities are whole numbers of this.
SCALE = 1_000_000_000
#: Added to each count.
SMOOTH = 2

#: Sources in a block of a term's postings.
BLOCK = 64
#: Entries that a task counts before it hands them on, and bytes of a text that it splits at once.
HELD, PIECE = 400_000, 1 << 20
#: Pairs of entries that are corrected at once, and matrices of pairs of blocks that a task holds.
PAIRS, MATRICES = 1 << 18, 256

#: Byte by byte: letters in lower case, bytes beyond ASCII as they are, all else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8 (runs of letters and of what is beyond ASCII), a piece of it at a time."""
    letters, at = text.translate(LETTERS), 0
    while at < len(letters):
        end = letters.find(b" ", at + PIECE)
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def _counted(batches: Iterator) -> Iterator:
    """Counts and documents of each (lang, source, term) of what a task has read, handed on in parts of `HELD`; a row without a term for each group."""
    import pyarrow as pa

    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def parts() -> Iterator:
        for (lang, source), (count, docs) in groups.items():
            n = len(count) + 1
            terms = pa.array([None, *count], pa.binary()).cast(pa.string(), safe=False)
            own = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), terms, pa.array([0, *count.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, count)], pa.int64())]
            yield pa.RecordBatch.from_arrays(own, names=["lang", "source", "term", "count", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            count, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(count), set()
            for piece in terms_of(text):
                count.update(piece)
                seen.update(piece)
            docs.update(seen)
            held += len(count) - before + 1
            if held > HELD:
                yield from parts()
                held = 0
    yield from parts()


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (n + 2 v)), in longs, and exact also where the product passes one."""
    whole = F.call_function("div", (count + SMOOTH) * F.lit(SCALE).cast("long"), n + 2 * v)
    wide = F.call_function("div", (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (n + 2 * v).cast("decimal(20,0)"))
    return (F.when(count < F.lit(9 * SCALE), whole).otherwise(wide) + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    """f: the whole part of (p - q)^2 / (p + q); below 2^60 before the division."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _both(batches: Iterator) -> Iterator:
    """Corrections of terms that two sources share, summed by pair over what a task has read: a matrix for each pair of blocks."""
    import numpy as np
    import pyarrow as pa

    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def entries(column) -> tuple:
        """Where each row's entries start, how many there are, and the fields of all of them."""
        offsets = np.asarray(column.offsets)
        return offsets[:-1], np.diff(offsets), *(np.asarray(column.values.field(k)) for k in ("at", "p", "zero"))

    def parts() -> Iterator:
        for (lang, i, j), m in sums.items():
            at = np.argwhere(m)
            n = len(at)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * n, pa.string()), "a": pa.array(at[:, 0] + i * BLOCK, pa.int64()), "b": pa.array(at[:, 1] + j * BLOCK, pa.int64()), "value": pa.array(m[at[:, 0], at[:, 1]], pa.int64())})
        sums.clear()

    for batch in batches:
        (start_a, n_a, at_a, p_a, zero_a), (start_b, n_b, at_b, p_b, zero_b) = entries(batch.column("own")), entries(batch.column("other"))
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j")), strict=True))
        # All pairs of a row's entries, for as many rows at once as give a bounded number of pairs.
        products = np.cumsum(n_a.astype(np.int64) * n_b)
        first = 0
        while first < len(keys):
            last = max(int(np.searchsorted(products, (products[first - 1] if first else 0) + PAIRS, "right")), first + 1)
            rows = np.arange(first, last)
            size = n_a[rows].astype(np.int64) * n_b[rows]
            row = np.repeat(rows, size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x, y = start_a[row] + k // n_b[row], start_b[row] + k % n_b[row]
            p, q, p0, q0 = p_a[x], p_b[y], zero_a[x], zero_b[y]
            value = f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
            own = {key: n for n, key in enumerate(dict.fromkeys(keys[first:last]))}
            at = (np.array([own[key] for key in keys[first:last]])[row - first] * BLOCK + at_a[x]) * BLOCK + at_b[y]
            total = np.zeros(len(own) * BLOCK * BLOCK, dtype=np.int64)
            np.add.at(total, at, value)
            for key, m in zip(own, total.reshape(-1, BLOCK, BLOCK), strict=True):
                sums[key] = sums[key] + m if key in sums else m
            first = last
            if len(sums) > MATRICES:
                yield from parts()
    yield from parts()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """What tells the sources of a language apart: `lang`, `source`, `part`, `item`, `value`, `rank`.

    Part `pair`: `item` is each other source of the language, `value` the sum of f over
    all kept terms. Part `term`: the `top` terms that the source has and that are likelier
    there than in its language, by f. Ranks are by value, then by item in UTF-8.

    A null text, language or source counts as ''. A row of `docs` is a document, also if
    it repeats; other columns are not read; an empty table gives no rows. A language
    without kept terms gives its pairs at 0, and a language of one source no pairs.

    Each text is read once, where it lies, and only sums are shuffled. Pairs of sources,
    which are the result, are made in blocks of `BLOCK` times `BLOCK`, so no language
    and no term is one task's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    thin = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counted = thin.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    # Tasks have counted what they read, so rows are dealt as they are, by term: sums by
    # source and sums over sources then meet in the same place.
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    over = W.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "count", F.sum("count").over(over).alias("total"), F.sum("docs").over(over).alias("docs"), (F.min("source").over(over) == F.col("source")).alias("head"))
    counts = materialise(counts.where((F.col("docs") >= least) | F.col("term").isNull()).drop("docs"), "counts")
    kept = counts.where("term is not null")
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count_if("head").alias("v"))

    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("rows"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = number_sections(groups.select("lang", "source", *map(zero, ("n", "rows", "lang_n", "v"))), ["lang"], [F.col("source")])
    groups = groups.withColumn("no", F.col("number") - 1).withColumn("zero", F.when(F.col("v") > 0, probability(F.lit(0).cast("long"), F.col("n"), F.col("v"))))
    groups = materialise(groups.drop("number"), "groups")

    own = looked_up(kept, groups.where("rows > 0"), ["lang", "source"], n="rows")
    postings = own.select("lang", "source", "no", "term", "zero", probability(F.col("count"), F.col("n"), F.col("v")).alias("p"), probability(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    postings = materialise(postings, "postings")

    # Each pair of blocks of a language, in both orders, is a key of its own.
    block = F.floor(F.col("no") / BLOCK).cast("int")
    placed = groups.withColumn("block", block)
    placed = placed.join(placed.groupBy("lang").agg(F.max("block").alias("__last")), "lang").withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    facing = placed.select("lang", F.col("block").alias("facing"), F.col("facing").alias("block"), F.col("no").alias("other"), F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    pairs = placed.join(facing, ["lang", "block", "facing"]).where("no <> other")
    base = F.when(F.col("v") > 0, F.col("v") * apart(F.col("zero"), F.col("other_zero"))).otherwise(0)
    base = pairs.select("lang", F.col("no").alias("a"), F.col("other").alias("b"), base.alias("value"))

    same = postings.groupBy("lang", "no", "p", "zero").agg(F.count("*").alias("times"))
    same = same.withColumn("block", block).join(placed.select("lang", "no", "facing"), ["lang", "no"])
    alone = same.join(facing, ["lang", "block", "facing"]).where("no <> other")
    alone = alone.withColumn("value", F.col("times") * (apart(F.col("p"), F.col("other_zero")) - apart(F.col("zero"), F.col("other_zero")))).where("value <> 0")
    alone = materialise(alone.groupBy("lang", F.col("no").alias("a"), F.col("other").alias("b")).agg(F.sum("value").alias("value")), "alone")

    entry = F.struct((F.col("no") % BLOCK).alias("at"), "p", "zero")
    # At most BLOCK entries: a source stands once in a term's postings.
    blocks = postings.groupBy("lang", "term", block.alias("i")).agg(F.collect_list(entry).alias("own"))
    blocks = materialise(blocks, "blocks")
    met = blocks.select("lang", "i", F.col("i").alias("j"), "own", F.col("own").alias("other"))
    if (groups.agg(F.max("no")).first()[0] or 0) >= BLOCK:
        others = blocks.where("i > 0").select("lang", "term", F.col("i").alias("j"), F.col("own").alias("other"))
        met = met.union(blocks.join(others, ["lang", "term"]).where("i < j").select("lang", "i", "j", "own", "other"))
    both = met.mapInArrow(_both, "lang string, a long, b long, value long")
    both = materialise(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).where("a <> b"), "both")
    # Blocks meet themselves in both orders, others in one.
    turned = lambda rows: rows.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    across = both.where(F.floor(F.col("a") / BLOCK) < F.floor(F.col("b") / BLOCK))

    total = base.union(alone).union(turned(alone)).union(both).union(turned(across)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "no", "source")
    told = total.join(names.select("lang", F.col("no").alias("a"), "source"), ["lang", "a"]).join(names.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    told = told.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    telling = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return told.union(telling)
