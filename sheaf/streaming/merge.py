"""Merging a stream of record rows into a store that is a log of changes.

A batch writes what it changes: its rows, and a mark for each row that goes. The
store is the last change of every row; reading puts the parts together, and every so
many batches they are written as one. So a batch reads the keys of the store, and
writes no more than its own size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql.types import StructType

from sheaf.operators.merge import ids_to_replace, latest_in_batch, row_key
from sheaf.sources.buckets import merge_into
from sheaf.sources.store import read_generation, write_generation

#: Batches after which the parts of a store are put together.
PARTS = 8


def _log(spark: SparkSession, store: str) -> tuple[int, list[str]]:
    """The last batch that was merged, and the parts that make up the store."""
    found = read_generation(spark, store, "log")
    row = found.first() if found is not None else None
    return (row["batch_id"], json.loads(row["parts"])) if row else (-1, [])


def _last(spark: SparkSession, parts: list[str], columns: list[str] | None = None) -> DataFrame:
    """The last change of each row, without rows that went. With `columns` no others are read."""
    rows = spark.read.parquet(*parts)
    named = row_key(rows)
    kept = rows.columns if columns is None else [*dict.fromkeys([*named, *columns, "__batch", "__live"])]
    if len(parts) == 1:
        return rows.select(*kept).where("__live").drop("__batch", "__live")
    last = rows.select(*kept).groupBy(*(F.col(n).alias(f"__k_{n}") for n in named)).agg(F.max_by(F.struct(*kept), "__batch").alias("r"))
    return last.select("r.*").where("__live").drop("__batch", "__live")


def read_records(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of a store; None before the first batch."""
    _, parts = _log(spark, store)
    return _last(spark, parts) if parts else None


def merge_batch(spark: SparkSession, store: str, batch: DataFrame, batch_id: int, seq: str = "seq") -> None:
    """Merge a batch; one that was merged already changes nothing, and a failed one leaves the store as it was."""
    done, parts = _log(spark, store)
    if done >= batch_id:
        return
    marked = lambda rows, live: rows.withColumns({"__batch": F.lit(batch_id).cast("long"), "__live": F.lit(live)})
    if not parts:
        changes = marked(latest_in_batch(batch, seq), True)
    else:
        known = spark.read.parquet(*parts)
        columns = [c for c in known.columns if c not in ("__batch", "__live")]
        # The store's columns also say what names a row.
        incoming = latest_in_batch(batch.select(*columns), seq)
        gone = ids_to_replace(_last(spark, parts, ["source_url"]), incoming)
        changes = marked(incoming, True).unionByName(marked(gone, False), allowMissingColumns=True)
    part = f"{store}/parts/{batch_id:012d}"
    changes.write.mode("overwrite").parquet(part)
    parts = [*parts, part]
    if len(parts) > PARTS:
        whole = f"{store}/parts/{batch_id:012d}-whole"
        marked(_last(spark, parts), True).write.mode("overwrite").parquet(whole)
        parts = [whole]
    write_generation({"log": spark.createDataFrame([(batch_id, json.dumps(parts))], "batch_id long, parts string")}, store)


def stream_merge(rows: DataFrame, store: str, checkpoint: str, interval: str | None = None, seq: str = "seq") -> StreamingQuery:
    """Start merging a stream of rows (`id`, `source_url`, `seq`, ...). Without an interval what is there is merged, and the query ends."""
    spark = rows.sparkSession
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_batch(spark, store, df, n, seq))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: A checkpoint takes in so many files of pages, or what has come in so long.
CHECKPOINT_FILES, CHECKPOINT_EVERY = 10, "10 seconds"


def page_stream(spark: SparkSession, folder: str, schema: StructType, files: int = CHECKPOINT_FILES, most_bytes: str | None = None) -> DataFrame:
    """Rows of the files that arrive in `folder`, oldest first, at most `files` of them (or `most_bytes`) a batch: a checkpoint that follows is bounded, however many wait."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", most_bytes) if most_bytes else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def stream_checkpoints(rows: DataFrame, store: str, checkpoint: str, every: str | None = CHECKPOINT_EVERY, seq: str = "seq") -> StreamingQuery:
    """Merge a bounded stream (see `page_stream`) into a store in parts (see `sources.buckets`): each batch is one checkpoint, which reads and writes only the parts it touches.

    A checkpoint that fails ends the query and leaves the store as the last one
    published it; started again with the same `checkpoint`, the query repeats the
    failed batch, and one that was published already changes nothing. With `every` a
    batch starts so often, else the query takes what is there, in bounded batches, and
    ends. Of a source that a batch reads twice the greatest `seq` counts; between
    batches the later one does.
    """

    def one(batch: DataFrame, number: int) -> None:
        merge_into(latest_in_batch(batch, seq), store, batch_id=number)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
