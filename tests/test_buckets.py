"""The store in parts, and bounded checkpoints of a stream into it."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators.merge import latest_in_batch, upsert
from sheaf.sources import buckets
from sheaf.sources.buckets import Layout, create, merge_into, opened, read_records, rebuilt
from sheaf.streaming.merge import page_stream, stream_checkpoints

ROW = "id string, category string, patient struct<key:string,name:string,label:string,relationship:string>, source_url string, title string, seq long"
SMALL = Layout(categories=("visits", "letters"), buckets=4, key_buckets=4)


def rows(spark, made):
    """Rows from (id, category, patient key, source number or text, title, seq)."""
    url = lambda s: s if s is None or isinstance(s, str) else f"https://p.example.org/page?id={s}"
    return spark.createDataFrame([(i, c, (p, p, p, "") if p is not None else None, url(s), t, n) for i, c, p, s, t, n in made], ROW)


def told(df):
    return sorted((r["id"], r["category"], r["patient"]["key"] if r["patient"] else None, r["title"]) for r in df.collect())


def test_merges_are_those_of_upsert(spark, tmp_path):
    import random

    rng, folder = random.Random(3), f"file://{tmp_path}/store"
    cats, whole = ["visits", "letters", "odd one", "", None], None
    for batch in range(3):
        made = {}
        for _ in range(60):
            i = f"r{rng.randrange(80)}"
            made[i] = (i, rng.choice(cats), rng.choice([*"abcdef", "", None]), rng.choice([*range(12), "", None, "https://p.example.org/app/visits/past-details?csn=5", "https://p.example.org/app/visits/note?csn=5"]), f"t{rng.randrange(3)}", batch)
        new = rows(spark, made.values())
        read = rows(spark, [("x", None, None, n, None, 0) for n in (1, 2, 20)]).select("source_url").union(new.select("source_url"))
        if batch == 0:
            create(spark, folder, new, SMALL)
            whole = new.limit(0)
        got = merge_into(new, folder, read, batch_id=batch)
        want = upsert(whole, new, read)
        delta = lambda d: sorted((r["id"], r["delta"]) for r in d.where("delta <> 'untouched'").collect())
        assert delta(got.changes) == delta(want)
        whole = spark.createDataFrame(want.where("delta <> 'deleted'").drop("delta").collect(), new.schema)
        assert told(read_records(spark, folder)) == told(whole)
    assert merge_into(new, folder, read, batch_id=2).changes is None
    assert told(read_records(spark, folder, categories=["letters", "odd one"])) == told(whole.where("category in ('letters', 'odd one')"))
    assert told(read_records(spark, folder, patients=["a", "b"])) == told(whole.where("patient.key in ('a', 'b')"))
    rebuilt(spark, folder, f"{folder}-2", Layout(categories=("visits",), buckets=2, key_buckets=1))
    assert told(read_records(spark, f"{folder}-2")) == told(whole) and opened(spark, f"{folder}-2").layout.buckets == 2


def test_a_row_that_moves_leaves_its_old_part(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    first = rows(spark, [("a", "visits", "ann", 1, "one", 0), ("b", "letters", "bob", 2, "two", 0)])
    create(spark, folder, first, SMALL)
    merge_into(first, folder)
    merge_into(rows(spark, [("a", "letters", "carl", 3, "moved", 1)]), folder)
    assert told(read_records(spark, folder)) == [("a", "letters", "carl", "moved"), ("b", "letters", "bob", "two")]
    # A source that gives nothing any more takes its rows along.
    merge_into(first.limit(0), folder, rows(spark, [("x", None, None, 2, None, 0)]).select("source_url"))
    assert told(read_records(spark, folder)) == [("a", "letters", "carl", "moved")]
    merge_into(first.limit(0), folder)
    assert told(read_records(spark, folder)) == [("a", "letters", "carl", "moved")]


def test_files_of_a_merge_stay_flat(spark, tmp_path):
    layout, read = Layout(categories=("visits",), buckets=16, key_buckets=16), []
    for size in (50, 500):
        folder = f"file://{tmp_path}/store{size}"
        own = spark.range(size * 20).select(
            F.concat(F.lit("r"), "id").alias("id"), F.lit("visits").alias("category"), F.struct(*((F.col("id") % size).cast("string").alias(n) for n in ("key", "name", "label")), F.lit("").alias("relationship")).alias("patient"),
            F.concat(F.lit("https://p.example.org/page?id="), "id").alias("source_url"), F.lit("t").alias("title"), F.lit(0).cast("long").alias("seq"),
        )
        create(spark, folder, own, layout)
        merge_into(own, folder)
        one = own.where("patient.key = '7'").withColumn("title", F.lit("new"))
        got = merge_into(one, folder)
        assert got.changes.where("delta = 'updated'").count() == 20 and got.parts == 1
        assert read_records(spark, folder).where("title = 'new'").count() == 20 and read_records(spark, folder).count() == size * 20
        read.append(got.files)
    # One part, and no more than the index has.
    assert max(read) <= 1 + 16


def test_layouts_and_names(spark, tmp_path):
    with pytest.raises(ValueError):
        Layout(categories=("a/b",))
    with pytest.raises(ValueError):
        Layout(buckets=0)
    with pytest.raises(ValueError):
        create(spark, f"file://{tmp_path}/s", spark.createDataFrame([], "id string"))
    with pytest.raises(ValueError):
        create(spark, f"file://{tmp_path}/s", spark.createDataFrame([], ROW + ", bucket int"))
    with pytest.raises(FileNotFoundError):
        opened(spark, f"file://{tmp_path}/none")


def test_a_failed_checkpoint_leaves_the_last_one(spark, tmp_path, monkeypatch):
    pages, store, checkpoint = (f"file://{tmp_path}/{n}" for n in ("pages", "store", "checkpoint"))
    batches = [[(f"p{k}-{j}", "visits", "ann", j, f"read {k}", k) for j in range(3)] for k in range(4)]
    for made in batches:
        rows(spark, made).coalesce(1).write.mode("append").parquet(pages)
    schema = rows(spark, []).schema
    create(spark, store, rows(spark, []), SMALL)
    published, real = [], buckets.write_generation

    def failing(tables, path):
        if len(published) == 2:
            raise OSError("the disk is full")
        published.append(path)
        return real(tables, path)

    monkeypatch.setattr(buckets, "write_generation", failing)
    query = stream_checkpoints(page_stream(spark, pages, schema, files=1), store, checkpoint, every=None)
    with pytest.raises(Exception, match="the disk is full"):
        query.awaitTermination()
    # Two checkpoints were published; the third wrote rows that no manifest names.
    assert opened(spark, store).batch_id == 1
    assert told(read_records(spark, store)) == [(f"p1-{j}", "visits", "ann", "read 1") for j in range(3)]
    monkeypatch.setattr(buckets, "write_generation", real)
    stream_checkpoints(page_stream(spark, pages, schema, files=1), store, checkpoint, every=None).awaitTermination()
    assert opened(spark, store).batch_id == 3
    assert told(read_records(spark, store)) == [(f"p3-{j}", "visits", "ann", "read 3") for j in range(3)]
    assert latest_in_batch(spark.read.schema(schema).parquet(pages)).count() == 3


def test_lookups_of_heavy_and_rare_keys(spark, monkeypatch):
    from sheaf.sources import shared

    monkeypatch.setattr(shared, "HEAVY", 4)
    some = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i}", i) for i in range(40)] + [(None, 1), ("unknown", 2)], "key string, x long")
    known = spark.createDataFrame([("hot", 60, "H")] + [(f"k{i}", 1, f"v{i}") for i in range(30)], "key string, n long, v string")
    got = sorted((r["key"] or "", r["x"], r["v"]) for r in shared.looked_up(some, known, ["key"]).collect())
    want = [("hot", i, "H") for i in range(60)] + [(f"k{i}", i, f"v{i}") for i in range(30)]
    assert got == sorted(want)
    left = sorted((r["key"] or "", r["x"], r["v"] or "") for r in shared.looked_up(some, known, ["key"], how="left").collect())
    assert left == sorted(want + [(f"k{i}", i, "") for i in range(30, 40)] + [("", 1, ""), ("unknown", 2, "")])
    assert shared.looked_up(some, known.limit(0), ["key"], how="left").count() == 102


def test_a_hot_source_in_a_batch(spark):
    made = [(f"h{i}", "visits", "p", "https://p.example.org/hot", f"t{i % 3}", i % 3) for i in range(90)] + [(f"o{i}", "visits", "p", i, "t", 0) for i in range(30)] + [("n", "visits", "p", None, "a", 1), ("n", "visits", "p", None, "b", 2), ("m", "visits", "p", 5, "c", None)]
    got = {r["id"]: r["title"] for r in latest_in_batch(rows(spark, made)).collect()}
    assert got == {f"h{i}": "t2" for i in range(90) if i % 3 == 2} | {f"o{i}": "t" for i in range(30)} | {"n": "b", "m": "c"}


def test_a_merge_writes_rows_and_keys_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "KEY_ROWS", 1)
    folder, made, real = f"file://{tmp_path}/store", [], buckets.materialise
    monkeypatch.setattr(buckets, "materialise", lambda df, name, by=(): made.append(name) or real(df, name, by))
    first = rows(spark, [("a", "visits", "ann", 1, "one", 0), ("b", "visits", "ann", 1, "two", 0), ("c", "letters", "bob", 2, "three", 0)])
    create(spark, folder, first, SMALL)
    merge_into(first, folder)
    # An empty store is not asked; what is read of it leaves no join behind.
    assert made == ["incoming"]
    got = merge_into(rows(spark, [("a", "visits", "ann", 1, "new", 1)]), folder)
    assert made == ["incoming", "incoming", "asked"]
    assert sorted((r["id"], r["delta"]) for r in got.changes.where("delta <> 'untouched'").collect()) == [("a", "updated"), ("b", "deleted")]
    assert got.changes.columns == [*first.columns, "delta"]
    s = opened(spark, folder)
    assert all(cat != buckets.DELETED for _, cat, _ in s.live) and sum(n for p, (_, n) in s.live.items() if p[0] == "rows") == 2
    # The index has each key once: two sources, three ids.
    keys = buckets._read(spark, folder, s, "keys", buckets.KEYS, [p[1:] for p in s.live if p[0] == "keys"])
    assert keys.count() == keys.distinct().count() == 5
    assert told(read_records(spark, folder)) == [("a", "visits", "ann", "new"), ("c", "letters", "bob", "three")]
