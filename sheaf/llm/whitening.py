"""Whitening of embeddings by statistics that partitions merge in pairs.

Each partition computes its count, its sums and its scatter about its own mean; two
such states merge by the pairwise formula, in a tree. The driver finds the eigenvectors
of one matrix, and a second pass over the whitened rows tells how near their covariance
is to the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import materialise, small_batches

#: Components told of each row.
COMPONENTS = 32
#: An entry c becomes the whole number floor(64 c) + 1,000,000.
STEP, SHIFT = 64, 1_000_000
#: Entries beyond this are cut to it: whole numbers stay exact in doubles.
LARGEST = 2.0**52
#: Widest vectors; a state is one square matrix of doubles.
MAX_DIM = 4096
#: Rows that are multiplied at once.
ROWS = 4096


class State(NamedTuple):
    """Count, exact sums by dimension (whole numbers of any size, or doubles), and scatter about the mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray


def state_of(x: np.ndarray) -> State:
    """The state of some rows: what is multiplied is centred first, by the rows' own mean."""
    n = len(x)
    if x.dtype.kind == "i":
        sums = np.array([int(s) for s in x.sum(axis=0, dtype=object)], dtype=object) if n and np.abs(x).max() > 2**62 // n else x.sum(axis=0).astype(object)
        low = x[0]
        # Differences to a row are exact, and their mean is small.
        near = (x - low).astype(float)
    else:
        sums, near = x.sum(axis=0), x - x[0]
    centred = near - near.mean(axis=0)
    return State(n, sums, centred.T @ centred)


def merged(a: State | None, b: State | None) -> State | None:
    """Chan's formula: scatters add, and the means' distance does with weight n m / (n + m)."""
    if a is None or b is None:
        return b if a is None else a
    n = a.n + b.n
    # Whole sums are of any size, so the difference of means is rounded once.
    apart = np.array([float(x) for x in (b.sums * a.n - a.sums * b.n)]) / (float(a.n) * b.n)
    return State(n, a.sums + b.sums, a.scatter + b.scatter + np.outer(apart, apart) * (float(a.n) * b.n / n))


def whole(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers of some vectors."""
    return np.clip(np.floor(vectors.astype(float) * STEP) + SHIFT, -LARGEST, LARGEST).astype(np.int64)


def _grouped(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: places and vectors. Other rows than usable ones have been left out."""
    import pyarrow as pa

    column = batch.column("vector")
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.values.cast(pa.float64()))
    starts = np.asarray(column.offsets)[:-1]
    for d in np.unique(lengths):
        if d:
            at = np.flatnonzero(lengths == d)
            for k in range(0, len(at), ROWS):
                part = at[k : k + ROWS]
                yield part, values[starts[part][:, None] + np.arange(d)]


def _states(rows: DataFrame, seen: Callable[[np.ndarray], np.ndarray]) -> dict[int, State]:
    """The state of `seen` of all rows for each length of their vectors, merged in a tree; one stored row a partition, a dictionary of states each."""

    def local(batches):
        import pyarrow as pa

        own: dict[int, State | None] = {}
        for batch in batches:
            for _, x in _grouped(batch):
                d = x.shape[1]
                own[d] = merged(own.get(d), state_of(seen(x)))
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(own)], pa.binary())})

    def both(a, b):
        return {d: merged(a.get(d), b.get(d)) for d in a.keys() | b.keys()}

    stored = materialise(rows.mapInArrow(local, "state binary"), "states").rdd.map(lambda r: pickle.loads(bytes(r["state"])))
    return {} if stored.isEmpty() else stored.treeReduce(both)


class Basis(NamedTuple):
    """What whitens vectors of one length: count, exact sums, components by falling eigenvalue as columns, eigenvalues, and their trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S of whole rows: exact, as whole numbers of any size where longs could overflow."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) < 2**62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(float) / self.n @ self.vectors / np.sqrt(self.values)


def basis(state: State, components: int) -> Basis:
    """Eigenvectors of the covariance; each one's largest entry is positive. Those without variance, which cannot be whitened, are left out."""
    d = len(state.sums)
    if d > MAX_DIM:
        raise ValueError(f"vectors of {d} dimensions are wider than {MAX_DIM}")
    cov = state.scatter / state.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum()))
    vectors = vectors[:, :kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0) if kept else vectors
    return Basis(state.n, state.sums, vectors, values[:kept], float(np.trace(cov)))


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """`id` and `vector` (doubles) of the rows that have a vector of finite numbers only; an empty one has no component."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id).alias("id"), v.alias("vector")).where(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: `id`, `n`, `deviation` (sum of (n x - S)^2, exact, as decimal; null beyond 38 digits), `whitened`, `explained` (arrays by component), `identity_error`.

    Rows without a vector, or with a null or a number that is not finite in it, are left
    out; they are not fitted either. All other rows are fitted, rows that repeat as often
    as they stand. Vectors of different lengths are spaces of their own, each with its own
    `n`, sums and components. Components without variance are left out, so rows that are
    all equal get empty arrays. Entries are cut to 2^52. Other columns are not read.

    Two passes that only send one square matrix a partition and length, merged in a
    tree, and a third that writes the rows; the bases (a matrix of at most `MAX_DIM` x
    `components` each) go with the tasks.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = usable(rows, id, vector)
    bases = {d: basis(s, components) for d, s in _states(own, whole).items()}
    shared = spark.sparkContext.broadcast(bases)
    checked = _states(own, lambda x: shared.value[x.shape[1]].whitened(whole(x)))
    errors = {d: float(np.abs(s.scatter / s.n - np.eye(len(s.sums))).max(initial=0.0)) for d, s in checked.items()}

    def out(batches):
        import pyarrow as pa

        schema = pa.schema([("__at", pa.int64()), ("n", pa.int64()), ("deviation", pa.string()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())])
        for batch in batches:
            for at, x in _grouped(batch):
                b = shared.value[x.shape[1]]
                x = whole(x)
                off = b.centred(x)
                exact = off if off.dtype == object or int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2**62 else off.astype(object)
                white = b.whitened(x)
                share = (b.values / b.trace).tolist() if len(b.values) else []
                own = pa.RecordBatch.from_pydict({"__at": at, "n": [b.n] * len(x), "deviation": [str(s) for s in (exact * exact).sum(axis=1)], "whitened": white.tolist(), "explained": [share] * len(x), "identity_error": [errors[x.shape[1]]] * len(x)}, schema=schema)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(own.column("__at")), *own.columns[1:]], names=["id", *own.schema.names[1:]])

    kind = own.schema["id"].dataType.simpleString()
    done = own.mapInArrow(out, f"id {kind}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double")
    return done.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)")).withColumnRenamed("id", id)


def by_component(white: DataFrame, id: str = "vec_id") -> DataFrame:
    """One row for each row and component (numbered from 1 by falling eigenvalue) of what `whiten` gives; `deviation` is null if it is no long."""
    zipped = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = white.select(id, "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", zipped.alias("at", "c"))
    return rows.select(id, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
