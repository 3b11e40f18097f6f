"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of five-word shingles. Texts with equal sets are one
   class, however many copies there are; all later work is on classes.
2. A class has 160 MinHash values. Classes that agree in one of 32 bands of five
   meet in that band's bucket (at similarity 0.8 all bands miss 3 times in a million).
3. In a bucket, pairs compare MinHash values 16 at a time; a pair whose posterior
   probability of reaching the threshold falls below the tolerance is dropped.
   What survives ties the bucket's classes together: candidate components.
4. Within a candidate component pairs are compared in the same way, whatever bucket
   they met in, and those that survive are verified exactly on their shingle sets,
   in blocks, giving each class its links and the component's final groups.

A bucket or component of more than `CHUNK` classes is cut into chunks, and every
pair of chunks is a task's group of its own: no group is collected as a whole, and
no pair is ever a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise, small_batches
from sheaf.llm.components import components
from sheaf.llm.words import words

WIDTH = 5
THRESHOLD = 0.8
TOLERANCE = 1e-7
BANDS, ROWS, STEP = 32, 5, 16
HASHES = BANDS * ROWS
CHUNK = 256
STORE = 100_000
_random = np.random.default_rng(20)
_A = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words seen by a task, in bounded number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < STORE:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of a text's runs of five words; of fewer words, of all of them; none without words."""
    own = words(text)
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    width = min(WIDTH, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _M + h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(some: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles."""
    x = (some >> np.uint64(32)).astype(np.uint32)
    parts = [(x[at : at + 4096, None] * _A + _B).min(0) for at in range(0, len(x), 4096)]
    return np.minimum.reduce(parts)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number n of compared values, the fewest matches with which a pair stays.

    Two values (their low byte) agree with probability s + (1 - s) / 256 at similarity
    s. With a flat prior the posterior of that probability after m of n matches is
    Beta(m + 1, n - m + 1), whose tail from t on is that of m or fewer successes in
    n + 1 draws at t.
    """
    t = threshold + (1 - threshold) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs (rows a and b of the signature bytes) survive the incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, m in least.items():
        matches = matches + (sig[a[alive], n - STEP : n] == sig[b[alive], n - STEP : n]).sum(1)
        stay = matches >= m
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is tied to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, root[a], low)
        root = root[root]
        open_ = root[a] != root[b]
        if not open_.any():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], at_least: int) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, as many together as the batches hold; the group that a batch leaves open goes on in the next."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = tuple(k[0] for k in keys)
        new[0] = last is not None and first != last
        last = tuple(k[-1] for k in keys)
        cuts = np.flatnonzero(new)
        if len(cuts):
            cut = int(cuts[-1])
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches([h for h in held if h.num_rows] or [batch.slice(0, 0)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
        for c in by:
            k = table.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _paired(rows: DataFrame, group: str, number: Column) -> DataFrame:
    """Deal each group's rows into chunks of about `CHUNK`, and repeat them for each pair of chunks they belong to: adds `lo`, `hi`, `side`."""
    chunks = F.ceil(number / CHUNK).cast("int")
    own = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(group)), F.col("chunks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return own.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).withColumn("side", (F.col("chunk") == F.col("hi")).cast("int")).drop("chunks", "chunk", "other")


def _sorted(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "cls")


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row with a text: `id`, `th` (hash of the text), `cls` (16 bytes), `sig` (the low bytes of the MinHash values), `bands`.

    Texts without words are one class if they are equal as texts; they meet no bucket.
    """

    @F.pandas_udf("cls binary, sig binary, bands array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            rows = []
            for t in some:
                own = shingles(t)
                if not len(own):
                    rows.append((hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16, key=b"wordless").digest(), b"", []))
                    continue
                s = signature(own)
                bands = np.full(BANDS, 7, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    bands = (bands ^ (bands >> np.uint64(31))) * _M + s[k::ROWS].astype(np.uint64)
                rows.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), s.astype(np.uint8).tobytes(), (bands ^ (bands >> np.uint64(29))).view(np.int64)))
            yield pd.DataFrame(rows, columns=["cls", "sig", "bands"])

    small_batches(docs.sparkSession)
    own = docs.where(F.col(text).isNotNull())
    return own.select(_id(docs, key).alias("id"), F.xxhash64(text).alias("th"), run(F.col(text)).alias("p")).select("id", "th", "p.*")


def _id(docs: DataFrame, key: str) -> Column:
    """A row's id: whole numbers as longs, anything else as it is."""
    return F.col(key).cast("long") if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.col(key)


def candidates(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Edges (`a`, `b`) that tie classes of surviving pairs together, bucket by bucket."""
    least = least_matches(threshold, tolerance)
    rows = classes.select("cls", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(full, "bucket").join(classes.select("cls", "sig"), "cls")
    dealt = _sorted(_paired(met, "bucket", F.col("n")).select("bucket", "lo", "hi", "cls", "sig"), "bucket")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["bucket", "lo", "hi"]
        for table in _groups(batches, by, 2):
            n = table.num_rows
            starts = _starts(table, by)
            size = np.diff(np.concatenate([starts, [n]]))
            left = np.repeat(starts + size, size) - np.arange(n)  # rows of the group from here on
            sig, ids = _fixed(table.column("sig"), HASHES), table.column("cls").to_pylist()
            kept_a, kept_b = [], []
            for d in range(1, int(size.max()) if n else 0):
                a = np.flatnonzero(left > d)
                stay = surviving(sig, a, a + d, least)
                kept_a.append(a[stay])
                kept_b.append(a[stay] + d)
            if not kept_a:
                continue
            root = _roots(n, np.concatenate(kept_a), np.concatenate(kept_b))
            tied = np.flatnonzero(root != np.arange(n))
            yield pa.RecordBatch.from_pydict({"a": pa.array([ids[i] for i in tied], pa.binary()), "b": pa.array([ids[i] for i in root[tied]], pa.binary())})

    return dealt.mapInArrow(task, "a binary, b binary").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, exactly: products of incidence matrices, some thousand shingles at a time."""
    sizes = np.array([len(s) for s in sets])
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code) > 1
    slot = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    row, code = row[often[code]], slot[code[often[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(code, [at, at + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[a:b], code[a:b] - at] = 1
        out += x @ x.T  # counts up to 4096 are exact in single precision
    np.fill_diagonal(out, sizes)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def linked_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some pairs reach the threshold: one by one if they are few, else from all overlaps at once."""
    size = np.array([len(s) for s in sets], np.float64)
    if len(a) <= 4 * len(sets):
        both = np.array([overlap(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.float64)
    else:
        both = overlaps(sets)[a, b]
    return both >= threshold * (size[a] + size[b] - both) - 1e-9


def verified(members: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """From `cls`, `comp`, `n` (classes in the component), `sig` and `text`: per class and group `cls`, `links`, `root`."""
    dealt = _sorted(_paired(members, "comp", F.col("n")).select("comp", "lo", "hi", "side", "cls", "sig", "text"), "comp")
    least = least_matches(threshold, tolerance)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["comp", "lo", "hi"]
        for table in _groups(batches, by, 2):
            starts = [*_starts(table, by), table.num_rows]
            ids, texts = table.column("cls").to_pylist(), table.column("text")
            side, sig = table.column("side").to_numpy(), _fixed(table.column("sig"), HASHES)
            cross = (table.column("lo").to_numpy() != table.column("hi").to_numpy())[starts[:-1]]
            out: tuple[list, list, list] = ([], [], [])
            for g, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                if b - a < 2:
                    continue
                i, j = np.triu_indices(b - a, 1)
                if cross[g]:
                    apart = side[a + i] != side[a + j]
                    i, j = i[apart], j[apart]
                stay = surviving(sig[a:b], i, j, least)
                i, j = i[stay], j[stay]
                if not len(i):
                    continue
                sets = [shingles(t) for t in texts.slice(a, b - a).to_pylist()]
                linked = linked_pairs(sets, i, j, threshold)
                i, j = i[linked], j[linked]
                root = _roots(b - a, i, j)
                n_links = np.bincount(np.concatenate([i, j]), minlength=b - a)
                out[0].extend(ids[a:b])
                out[1].extend(n_links.tolist())
                out[2].extend(ids[a + r] for r in root)
            yield pa.RecordBatch.from_pydict({"cls": pa.array(out[0], pa.binary()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.binary())})

    return dealt.mapInArrow(task, "cls binary, links long, root binary")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row with a text: `id`, `th`, `cls`, `copy_of` (smallest id of equal texts), `links`, `group` (smallest id of the near-duplicate group).

    `links` counts the other classes with a Jaccard similarity of `threshold` or more
    on five-word shingles; copies are not expanded. Groups are the connected
    components of links. Texts of fewer than five words have one shingle. Rows with
    a null text are left out; null ids are no group's smallest, unless there is no
    other, when they stay null. Repeated rows are copies.
    """
    rows = materialise(profile(docs, key, text), "profile")
    # One row stands for its class in all that needs its text, so its copies' texts are not moved.
    first = F.min(F.struct("th", "id"))
    classes = rows.groupBy("cls").agg(F.min("id").alias("copy_of"), first.alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    classes = materialise(classes, "classes")
    comps = components(candidates(classes, threshold, tolerance)).select(F.col("node").alias("cls"), F.xxhash64("root").alias("comp"))
    comps = materialise(comps, "candidates")
    many = comps.groupBy("comp").agg(F.count("*").alias("n")).withColumn("size", F.col("n"))
    sized = looked_up(comps, materialise(many, "sizes"), ["comp"]).join(classes.select("cls", "first", "sig"), "cls").select("*", F.xxhash64("first.th", "first.id").alias("row"), F.col("first.th").alias("th"))
    texts = docs.where(F.col(text).isNotNull()).select(_id(docs, key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    texts = texts.select(F.xxhash64("th", "id").alias("row"), "th", "text")
    # Rows that repeat id and text still meet; a map-side aggregate leaves one of them a task and class.
    one = texts.join(sized, ["row", "th"]).groupBy("cls").agg(F.first("text").alias("text"), F.first("comp").alias("comp"), F.first("size").alias("n"), F.first("sig").alias("sig"))
    found = materialise(verified(one, threshold, tolerance), "verified")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    least = roots.join(classes.select("cls", "copy_of"), roots["node"] == classes["cls"]).groupBy("root").agg(F.min("copy_of").alias("group"), F.count("*").alias("n"))
    grouped = looked_up(roots, materialise(least, "least"), ["root"]).select(F.col("node").alias("cls"), "group").join(links, "cls", "left")
    whole = classes.select("cls", "copy_of", "n").join(grouped, "cls", "left")
    whole = whole.select("cls", "copy_of", "n", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group", "copy_of").alias("group"))
    return looked_up(rows.select("id", "th", "cls"), materialise(whole, "whole"), ["cls"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group, that with the smallest id; same columns.

    Rows with a null text stay. Of rows that repeat id and text one stays.
    """
    found = materialise(join(docs, key, text).select("id", "th", "group"), "groups")
    gone = found.where(~F.col("id").eqNullSafe(F.col("group"))).select(F.col("id").alias("__j_id"), F.col("th").alias("__j_th")).distinct()
    own = docs.withColumn("__j_th", F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    rest = own.join(gone, _id(docs, key).eqNullSafe(gone["__j_id"]) & (own["__j_th"] == gone["__j_th"]), "left_anti")
    if found.groupBy("id", "th").count().where("count > 1").limit(1).count():
        texts = rest.where(F.col(text).isNotNull())
        one = texts.groupBy(F.col(key).alias("__j_key"), "__j_th").agg(F.first(F.struct(*docs.columns)).alias("__j_row")).select("__j_row.*")
        rest = one.unionByName(rest.where(F.col(text).isNull()).select(*docs.columns))
    return rest.select(*docs.columns)
