"""The folder that driver and executors share, and what their Python tasks take at once."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below `spark.checkpoint.dir`; a local session without one gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder, in a folder for each value of `by`, and read it back.

    This cuts the lineage in a place that outlives any executor, and gives the
    planner the table's true size, on which broadcasts depend.
    """
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket of a table that is laid out.
BUCKET_ROWS = 50_000


def laid_out(df: DataFrame, name: str, by: str, rows: int) -> DataFrame:
    """`materialise`, with about so many rows laid in buckets by a key and sorted in them: joins by it move the other side only."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    buckets = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    called = f"sheaf_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(called)
    return spark.table(called)


#: Keys that more than one in so many rows ask for are fewer than this.
HEAVY = 10_000


def looked_up(rows: DataFrame, known: DataFrame, by: Sequence[str], n: str = "n", total: int | None = None, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `known` (one row for each key `by`); those without one are left out, or with `how` left come with nulls.

    `n` of `known` is how many rows ask for a key, `total` how many ask for any. Keys
    that more than one in `HEAVY` rows ask for are at most `HEAVY` rows, whatever the
    data, and go by broadcast; what is left for the shuffle has no heavy key but those
    that `known` does not have. Keys that are null have no row in `known`, and pass by.
    """
    by = list(by)
    if total is None:
        total = known.agg(F.sum(n)).first()[0] or 0
    payload = [c for c in known.columns if c != n and c not in by]
    many = known.where(F.col(n) > total / HEAVY).drop(n).withColumn("__heavy", F.lit(True))
    few = known.where(F.col(n) <= total / HEAVY).drop(n)
    tried = rows.join(F.broadcast(many), by, "left")
    found = tried.where("__heavy").drop("__heavy")
    rest = tried.where("__heavy is null").drop("__heavy", *payload)
    if how == "inner":
        return found.unionByName(rest.join(few, by))
    none = " or ".join(f"`{c}` is null" for c in by)
    passing = rest.where(none)
    return found.unionByName(rest.where(f"not ({none})").join(few, by, "left")).unionByName(passing, allowMissingColumns=True)


#: Bytes of rows that a Python task takes at once.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of bounded bytes.

    Spark's 64 MB of text become several times that as Python objects, in each of an
    executor's workers, and workers keep what they once took.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
