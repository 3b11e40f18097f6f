"""Nearest neighbours over shifted space-filling curves.

Unit vectors are projected to a few dimensions, several times over, each time with
another projection and shift, and ordered along a Hilbert curve. Spark
range-partitions each ordering; a query meets the rows of its neighbouring keys in
every ordering, and what the windows give is merged and reranked on the original
vectors. Equal vectors are one entry with their smallest ids, however many there are.

Windows alone are sure only where the data lie in clusters. So the k-th score they
give is carried on as a bound: blocks of the first ordering know their centre and
angular radius, and those that could hold a better vector for some query are
searched too. With that the result is exact. A query batch meets the blocks it
cannot rule out; on clustered data these are few, on isotropic data most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import materialise

ORDERINGS, DIMENSIONS, BITS = 4, 6, 10
#: Rows of a block, rows on either side of a block that its queries also meet, and queries of a batch.
BLOCK, HALO, BATCH = 2048, 256, 1024


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by turning each bit plane's cell upright before the next."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            one = (x[i] & q) != 0
            swap = np.where(one, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(one, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray, ordering: int) -> np.ndarray:
    """Keys of vectors in an ordering: its own projection and shift, the same in every task."""
    random = np.random.default_rng([7, ordering])
    dim = vectors.shape[1]
    axes = np.linalg.qr(random.normal(size=(dim, min(DIMENSIONS, dim))))[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cell = (1 << BITS) - 1
    # About three deviations of an isotropic projection, less a quarter for the shift.
    place = (unit @ axes) * np.sqrt(dim) / 3 * 0.375 + 0.5 + random.uniform(-0.125, 0.125, axes.shape[1])
    return hilbert(np.clip(np.round(place * cell), 0, cell))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`id`, `vector`: rows with an id whose vector has finite components, and not only zeros."""
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(~bad & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


FOUND = "query string, id long, score double"


def _found(queries: list[str], ids: list[int], scores: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["query", "id", "score"])


def _best(q_names: list[str], q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int, least: np.ndarray | None = None) -> pa.RecordBatch:
    """For each query the ids of its k + 1 best rows (all with equal vectors), those scoring at least `least`."""
    qu, xu = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    near = qu @ xu.T
    # One more for the query itself; all that rounding may have put behind, so that ties are cut by id.
    top = min(k + 1, near.shape[1])
    last = -np.partition(-near, top - 1, axis=1)[:, top - 1]
    row, col = np.nonzero(near >= last[:, None] - 1e-9)
    if least is not None:
        stay = near[row, col] >= least[row] - 1e-9
        row, col = row[stay], col[stay]
    scores = cosines(q[row], x[col]) if len(row) else np.zeros(0)
    found = sorted((r, -s, i) for r, c, s in zip(row.tolist(), col.tolist(), scores.tolist(), strict=True) for i in ids[c])
    made = [(q_names[r], i, -s) for _, own in groupby(found, lambda x: x[0]) for r, s, i in islice(own, k + 1)]
    return _found([m[0] for m in made], [m[1] for m in made], [m[2] for m in made])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, ties to smaller ids. Spark keeps k rows of a query in each task before the shuffle."""
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k rows of largest cosine for each row for which `is_query` (over `id`) holds.

    A query's own id is no candidate. Equal scores rank by smaller id. With fewer than
    k candidates there are fewer rows, and none for unusable vectors. Repeated rows
    count once; of an id with several vectors the nearest pair counts. Vectors of
    different lengths have no cosine: each length is a space of its own, searched
    after the other.
    """
    rows = usable(vectors, vec_id, embedding)
    # One row a length.
    lengths = sorted(r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().collect())
    found = None
    for n in lengths or [0]:
        one = _search(rows.where(F.size("vector") == n), is_query, k)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def windows_only(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """As `search` for vectors of one length, but only what the windows give: `query_id`, `vec_id`, `score`, for measuring."""
    return _search(usable(vectors, vec_id, embedding), is_query, k, exact=False)


def _search(rows: DataFrame, is_query: Column, k: int, exact: bool = True) -> DataFrame:
    """`query_id`, `vec_id`, `score` of at least the k nearest of each query among usable rows of one length."""
    rows = materialise(rows.withColumn("name", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","))).dropDuplicates(["name", "id"]), "vectors")
    # Equal vectors: one entry with its k + 1 smallest ids, one of which may be the query.
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = ranked.groupBy("name").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where(is_query).select(F.col("id").alias("query_id"), "name")
    entries = materialise(entries.join(asked.select("name").distinct().withColumn("asks", F.lit(True)), "name", "left"), "entries")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"))
            for c in range(ORDERINGS):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), c, np.int32)), pa.array(curve_keys(x, c) if len(x) else np.zeros(0, np.int64))], names=[*b.schema.names, "ordering", "place"])

    schema = "name string, vector array<double>, ids array<long>, asks boolean, ordering int, place long"
    parts = max(ORDERINGS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = entries.select("name", "vector", "ids", "asks").mapInArrow(keyed, schema).repartitionByRange(parts, "ordering", "place", "name").sortWithinPartitions("ordering", "place", "name")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of an ordering (all rows of the first one, and every block's findings), with some rows before and behind."""
        for run in _runs(batches):
            names, ids, asks = run.column("name").to_pylist(), run.column("ids").to_pylist(), run.column("asks").fill_null(False).to_numpy()
            x = _matrix(run.column("vector"))
            ordering = run.column("ordering")[0].as_py()
            for at in range(0, len(x), BLOCK):
                end = min(at + BLOCK, len(x))
                low, high = max(0, at - HALO), min(len(x), end + HALO)
                q = at + np.flatnonzero(asks[at:end])
                made = _best([names[i] for i in q], x[q], x[low:high], ids[low:high], k) if len(q) else _found([], [], [])
                unit = x[at:end] / np.linalg.norm(x[at:end], axis=1, keepdims=True)
                centre = unit.mean(0)
                centre = centre / max(np.linalg.norm(centre), 1e-300)
                radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1)))
                first = ordering == 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([names[at] if first else None], pa.string()),
                        "centre": pa.array([centre.tolist() if first else None], pa.list_(pa.float64())),
                        "radius": pa.array([radius], pa.float64()),
                        "vectors": pa.array([x[at:end].tobytes() if first else None], pa.binary()),
                        "ids": pa.array([ids[at:end] if first else None], pa.list_(pa.list_(pa.int64()))),
                        "found": pa.array([made.to_pylist()], pa.list_(pa.struct([("query", pa.string()), ("id", pa.int64()), ("score", pa.float64())]))),
                    }
                )

    kind = "block string, centre array<double>, radius double, vectors binary, ids array<array<long>>, found array<struct<query:string,id:long,score:double>>"
    index = materialise(placed.mapInArrow(windows, kind), "index")
    near = materialise(_top(index.select(F.explode("found").alias("f")).select("f.*"), k + 1).drop("rank"), "windows")

    if not exact:
        return _answers(asked, near)

    # What the windows leave open: blocks that could hold a better row for a query of a batch. A batch is a stretch of queries along the first ordering.
    blocks = index.where("block is not null")
    bound = near.groupBy(F.col("query").alias("name")).agg(F.count("*").alias("n"), F.min("score").alias("least")).select("name", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(-2.0)).alias("least"))
    waiting = entries.where("asks").select("name", "vector").join(bound, "name")

    def queued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve_keys(x, 0) if len(x) else np.zeros(0, np.int64))], names=[*b.schema.names, "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            for at in range(0, run.num_rows, BATCH):
                some = run.slice(at, BATCH)
                q = _matrix(some.column("vector"))
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                centre = unit.mean(0)
                centre = centre / max(np.linalg.norm(centre), 1e-300)
                least = some.column("least").to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "batch": pa.array([some.column("name")[0].as_py()]),
                        "q_centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                        "q_radius": pa.array([float(np.arccos(np.clip((unit @ centre).min(), -1, 1)))]),
                        "least": pa.array([min(least)]),
                        "queries": pa.array([q.tobytes()], pa.binary()),
                        "names": pa.array([some.column("name").to_pylist()], pa.list_(pa.string())),
                        "limits": pa.array([least], pa.list_(pa.float64())),
                    }
                )

    many = max(1, -(-asked.select("name").distinct().count() // BATCH))
    queue = waiting.mapInArrow(queued, "name string, vector array<double>, least double, place long").repartitionByRange(many, "place").sortWithinPartitions("place")
    batches_ = materialise(queue.mapInArrow(packed, "batch string, q_centre array<double>, q_radius double, least double, queries binary, names array<string>, limits array<double>"), "batches")
    # Equi-joins on a share of the batches: each block's centre is repeated for all shares, its rows only for the batches it cannot be ruled out for.
    number = batches_.select("batch", "q_centre", "q_radius", "least").withColumn("share", F.pmod(F.xxhash64("batch"), F.lit(many)).cast("int"))
    thin = blocks.select("block", "centre", "radius")
    spread = thin.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    cosine = F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    apart = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) - F.col("radius") - F.col("q_radius")
    best = F.when(apart <= 0, F.lit(1.0)).otherwise(F.cos(apart))
    open_ = spread.join(number, "share").where(best >= F.col("least") - 1e-9).select("block", "batch")
    pairs = open_.join(blocks.select("block", F.col("vectors").alias("x"), "ids", "centre", "radius"), "block").join(batches_.select("batch", "queries", "names", "limits"), "batch")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                ids, names, least = row["ids"].as_py(), row["names"].as_py(), np.array(row["limits"].as_py())
                x = np.frombuffer(row["x"].as_py()).reshape(len(ids), -1)
                q = np.frombuffer(row["queries"].as_py()).reshape(len(names), -1)
                theta = np.arccos(np.clip(q @ np.array(row["centre"].as_py()) / np.linalg.norm(q, axis=1), -1, 1)) - row["radius"].as_py()
                can = np.where(theta <= 0, 1.0, np.cos(theta)) >= least - 1e-9
                if can.any():
                    yield _best([names[i] for i in np.flatnonzero(can)], q[can], x, ids, k, least[can])

    more = pairs.select("x", "ids", "centre", "radius", "queries", "names", "limits").repartition(parts).mapInArrow(scan, FOUND)
    return _answers(asked, materialise(_top(near.unionByName(more), k + 1).drop("rank"), "best"))


def _answers(asked: DataFrame, best: DataFrame) -> DataFrame:
    """What was found for a vector goes to all ids that ask with it, but not their own."""
    return asked.join(best.withColumnRenamed("query", "name"), "name").where("id <> query_id").select("query_id", F.col("id").alias("vec_id"), "score")


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 16 * BLOCK) -> Iterator[pa.Table]:
    """Sorted rows of one ordering at a time, in pieces of bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        order = b.column("ordering").to_numpy()
        cuts = [0, *(np.flatnonzero(order[1:] != order[:-1]) + 1).tolist(), len(order)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (order[a] != last or sum(h.num_rows for h in held) >= rows):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = order[a]
    if held:
        yield pa.Table.from_batches(held)
