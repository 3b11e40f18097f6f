"""A record store in parts: rows lie by category and patient bucket, and a merge reads and writes only the parts that it touches.

Which parts a batch touches is looked up in an index of ids, sources and visits, which
lies in buckets of its own. A manifest names the folder of each part; publishing a new
manifest (see `store.write_generation`) is what makes a merge visible, so a merge that
fails leaves the store as it was. The layout is fixed when a store is made, so what is
gathered on the driver, the numbers of touched parts, is bounded by it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf.functions.text import first_nonempty, or_empty
from sheaf.functions.urls import is_past_visit_detail, source_url_key, visit_key
from sheaf.operators.merge import row_key, upsert
from sheaf.sources.shared import materialise
from sheaf.sources.store import read_generation, write_generation

MANIFEST = "kind string, cat string, bucket int, gen string, rows long"
#: Where rows of no category of the layout lie.
OTHER = "other"
#: Where a merge leaves the rows that it deleted, for its changes to tell; no manifest names it, and no category can.
DELETED = "deleted.rows"


@dataclass(frozen=True)
class Layout:
    """Categories with parts of their own, buckets of patients in each, and buckets of the index."""

    categories: tuple[str, ...] = ("health-summary", "letters", "medications", "test-results", "visits")
    buckets: int = 64
    key_buckets: int = 64

    def __post_init__(self) -> None:
        if bad := [x for x in self.categories if not re.fullmatch(r"[a-z0-9_-]+", x) or x == OTHER]:
            raise ValueError(f"categories that name no folder: {bad}")
        if min(self.buckets, self.key_buckets) < 1:
            raise ValueError("a layout has buckets")

    def cat(self) -> Column:
        return F.when(or_empty("category").isin(*self.categories), F.col("category")).otherwise(OTHER)

    def bucket(self) -> Column:
        """Patients are dealt by their keys; rows without one lie by their ids, so none of these buckets is hot."""
        who = first_nonempty("patient.key", "patient.label", "patient.name")
        return F.pmod(F.xxhash64(F.when(who != "", who).otherwise(or_empty("id"))), F.lit(self.buckets)).cast("int")

    def key_bucket(self) -> Column:
        """Of the index."""
        return F.pmod(F.xxhash64("kind", "key"), F.lit(self.key_buckets)).cast("int")


@dataclass(frozen=True)
class Store:
    """What a published generation says: layout, columns of the rows, the last batch, and the live parts (kind, cat, bucket) with their folders and rows."""

    layout: Layout
    schema: StructType
    batch_id: int
    live: dict[tuple[str, str, int], tuple[str, int]]


@dataclass(frozen=True)
class Merged:
    """What a merge did: `changes` (the rows of the touched parts with `delta`), how many parts it touched, and the files it read."""

    changes: DataFrame | None
    parts: int
    files: int


def _publish(spark: SparkSession, path: str, s: Store) -> None:
    rows = [(*part, *at) for part, at in s.live.items()]
    head = [(json.dumps(asdict(s.layout)), s.schema.json(), s.batch_id)]
    write_generation({"manifest": spark.createDataFrame(rows, MANIFEST).coalesce(1), "head": spark.createDataFrame(head, "layout string, schema string, batch_id long").coalesce(1)}, path)


def create(spark: SparkSession, path: str, rows: DataFrame, layout: Layout | None = None) -> None:
    """An empty store for rows with the columns of `rows`, which need `id`, `category`, `patient` and `source_url`."""
    if missing := {"id", "category", "patient", "source_url"} - set(rows.columns):
        raise ValueError(f"rows of a store need {sorted(missing)}")
    if clash := {"cat", "bucket", "gen", "delta"} & set(rows.columns):
        raise ValueError(f"names that a store uses: {sorted(clash)}")
    _publish(spark, path, Store(layout or Layout(), rows.schema, -1, {}))


def opened(spark: SparkSession, path: str) -> Store:
    """The last published generation. Its manifest has at most (categories + 1) x buckets + index buckets rows."""
    head = read_generation(spark, path, "head")
    if head is None:
        raise FileNotFoundError(f"no store at {path}")
    said = head.first()
    layout = json.loads(said["layout"])
    layout["categories"] = tuple(layout["categories"])
    live = {(r["kind"], r["cat"], r["bucket"]): (r["gen"], r["rows"]) for r in read_generation(spark, path, "manifest").collect()}
    return Store(Layout(**layout), StructType.fromJson(json.loads(said["schema"])), said["batch_id"], live)


def _read(spark: SparkSession, path: str, s: Store, kind: str, schema: StructType, parts: Sequence[tuple[str, int]]) -> DataFrame:
    """The rows of some parts; only their folders are listed."""
    folders = [f"{path}/{kind}/gen={s.live[kind, *p][0]}/cat={p[0]}/bucket={p[1]}" for p in parts if (kind, *p) in s.live]
    if not folders:
        # The planner knows that this is empty, and leaves out what it is joined with.
        return spark.range(0).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    names = [f.name for f in schema]
    whole = StructType([*schema]).add("gen", "string").add("cat", "string").add("bucket", "integer")
    return spark.read.schema(whole).option("basePath", f"{path}/{kind}").parquet(*folders).select(*names)


def _write(rows: DataFrame, path: str, kind: str, gen: str) -> None:
    """Rows (with `cat` and `bucket`) into the parts of a generation. Small parts are written together, large ones by several tasks."""
    rows.hint("rebalance", "cat", "bucket").write.partitionBy("cat", "bucket").parquet(f"{path}/{kind}/gen={gen}")


def _written(spark: SparkSession, path: str, kind: str, gen: str, schema: StructType) -> DataFrame:
    """What `_write` wrote, with `cat` and `bucket`."""
    whole = StructType([*schema]).add("cat", "string").add("bucket", "integer")
    return spark.read.schema(whole).parquet(f"{path}/{kind}/gen={gen}")


def _parts(rows: DataFrame, kind: str, gen: str) -> dict[tuple[str, str, int], tuple[str, int]]:
    """The parts of what was written; files tell their rows without being read."""
    return {(kind, r["cat"], r["bucket"]): (gen, r["n"]) for r in rows.groupBy("cat", "bucket").agg(F.count("*").alias("n")).collect()}


KEYS = StructType().add("kind", "string").add("key", "string").add("row_cat", "string").add("row_bucket", "integer")


#: Keys that a file of the index has, about.
KEY_ROWS = 250_000


def _write_keys(keys: DataFrame, path: str, gen: str, layout: Layout, most: int) -> None:
    """Distinct keys into the index, of `most` at most. Keys are dealt once, by their bucket and a part of it: equal ones meet there, and a bucket has as many files as it has parts."""
    deals = 1 + most // (layout.key_buckets * KEY_ROWS)
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(deals))
    dealt = keys.withColumns({"bucket": layout.key_bucket(), "part": part}).repartition("bucket", "part").distinct()
    dealt.drop("part").withColumn("cat", F.lit("all")).write.partitionBy("cat", "bucket").parquet(f"{path}/keys/gen={gen}")


def _row_keys(rows: DataFrame) -> DataFrame:
    """What rows (with `cat` and `bucket`) can be found by: their ids, sources, and visits of past details; rows of a source give its key again."""
    names = row_key(rows)
    whole = F.concat_ws("\0", *(or_empty(n) for n in names))
    visit = F.when(is_past_visit_detail(F.col("source_url")), visit_key(F.col("source_url")))
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("id", whole), ("source", source_url_key(F.col("source_url"))), ("visit", visit))))
    own = rows.select(F.explode(each).alias("k"), F.col("cat").alias("row_cat"), F.col("bucket").alias("row_bucket"))
    return own.select("k.*", "row_cat", "row_bucket").where("key is not null and key <> ''")


def _asked(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """What stored rows that a batch meets are found by: the ids of its rows (one a key), and the sources and visits of what was read. A row's own source and visit are among these."""
    whole = F.concat_ws("\0", *(or_empty(n) for n in row_key(rows)))
    return rows.select(F.lit("id").alias("kind"), whole.alias("key")).where("key <> ''").union(_read_keys(urls.distinct()))


def _read_keys(urls: DataFrame) -> DataFrame:
    """What stored rows that a reading replaces are found by."""
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("source", source_url_key(F.col("source_url"))), ("visit", visit_key(F.col("source_url"))))))
    return urls.select(F.explode(kinds).alias("k")).select("k.*").where("key is not null and key <> ''").distinct()


def merge_into(incoming: DataFrame, path: str, sources: DataFrame | None = None, batch_id: int | None = None) -> Merged:
    """Merge rows (one a key, see `merge.latest_in_batch`) into a store, by the rules of `merge.upsert`; `sources` are the pages that were read, if some gave no row.

    Only parts that hold a row with an id, a source or a visit of the batch, and those
    that its own rows go to, are read and written anew; so a merge costs what the
    touched parts hold, however large the store is. The index may name parts that no
    longer hold a key, which costs a reading; `rebuilt` clears it of these. A batch
    whose number was merged already changes nothing.
    """
    spark = incoming.sparkSession
    s = opened(spark, path)
    if batch_id is not None and s.batch_id >= batch_id:
        return Merged(None, 0, 0)
    names = [f.name for f in s.schema]
    placed = lambda rows: rows.withColumns({"cat": s.layout.cat(), "bucket": s.layout.bucket()})
    new = materialise(placed(incoming.select(*names)), "incoming")
    urls = new.select("source_url") if sources is None else new.select("source_url").union(sources.select("source_url"))
    asked, buckets = new.select(F.lit("").alias("kind"), F.lit("").alias("key")).where(F.lit(False)), []
    # An empty store is asked nothing.
    if any(kind == "keys" for kind, _, _ in s.live):
        asked = materialise(_asked(new, urls).withColumn("bucket", s.layout.key_bucket()), "asked")
        # Numbers of buckets and parts: as many as the layout has, at most.
        buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
    known = _read(spark, path, s, "keys", KEYS, [("all", b) for b in buckets])
    hits = known.join(asked.select("kind", "key"), ["kind", "key"], "left_semi").select("row_cat", "row_bucket").distinct()
    touched = {tuple(r) for r in hits.union(new.select("cat", "bucket").distinct()).collect()}

    old = _read(spark, path, s, "rows", s.schema, sorted(touched))
    gone = F.col("delta") == "deleted"
    gen = f"{len({g for g, _ in s.live.values()}):06d}-{uuid.uuid4().hex}"
    live = {p: where for p, where in s.live.items() if p[0] != "rows" or p[1:] not in touched}
    # Rows are written once, into their parts with their delta, which readings of parts leave out.
    out = placed(upsert(old, new.select(*names), sources))
    _write(out.withColumn("cat", F.when(gone, DELETED).otherwise(F.col("cat"))), path, "rows", gen)
    out = _written(spark, path, "rows", gen, StructType([*s.schema]).add("delta", "string"))
    rewritten = _parts(out.where(F.col("cat") != DELETED), "rows", gen)
    live |= rewritten

    fresh = _row_keys(out.where("delta in ('inserted', 'updated')"))
    most = sum(n for p, (_, n) in s.live.items() if p[0] == "keys" and p[2] in buckets) + 3 * sum(n for _, n in rewritten.values())
    _write_keys(known.union(fresh), path, gen, s.layout, most)
    live |= _parts(_written(spark, path, "keys", gen, KEYS), "keys", gen)
    _publish(spark, path, Store(s.layout, s.schema, s.batch_id if batch_id is None else batch_id, live))
    return Merged(out.drop("cat", "bucket"), len(touched), len(old.inputFiles()) + len(known.inputFiles()))


def read_records(spark: SparkSession, path: str, categories: Sequence[str] | None = None, patients: Sequence[str] | None = None) -> DataFrame:
    """The rows of a store. Of some categories, or patients by key, only their parts are listed and read."""
    s = opened(spark, path)
    parts = [p[1:] for p in s.live if p[0] == "rows"]
    some = F.lit(True)
    if categories is not None:
        here = {x if x in s.layout.categories else OTHER for x in categories}
        parts = [p for p in parts if p[0] in here]
        some = some & or_empty("category").isin(*categories)
    if patients is not None:
        asked = spark.createDataFrame([(x,) for x in patients], "key string").select(F.struct(*(F.col("key").alias(n) for n in ("key", "label", "name"))).alias("patient"), F.lit("").alias("id"))
        here = {r[0] for r in asked.select(s.layout.bucket()).distinct().collect()}
        parts = [p for p in parts if p[1] in here]
        some = some & F.col("patient.key").isin(*patients)
    return _read(spark, path, s, "rows", s.schema, sorted(parts)).where(some)


def rebuilt(spark: SparkSession, path: str, to: str, layout: Layout | None = None) -> None:
    """A store written anew at `to`, in another layout if one is given, with an index of what it holds and no more."""
    s = opened(spark, path)
    create(spark, to, spark.createDataFrame([], s.schema), layout or s.layout)
    own = opened(spark, to)
    rows = read_records(spark, path).withColumns({"cat": own.layout.cat(), "bucket": own.layout.bucket()})
    gen = uuid.uuid4().hex
    _write(rows, to, "rows", gen)
    live = _parts(_written(spark, to, "rows", gen, s.schema), "rows", gen)
    _write_keys(_row_keys(rows), to, gen, own.layout, 3 * sum(n for _, n in live.values()))
    live |= _parts(_written(spark, to, "keys", gen, KEYS), "keys", gen)
    _publish(spark, to, Store(own.layout, s.schema, s.batch_id, live))
