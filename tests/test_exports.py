"""Ordered exports, large documents, titles by substrings, and steps of a caller's own."""

import json
import random

from pyspark.sql import functions as F

from sheaf import bindings as B
from sheaf.jobs import export as jobs
from sheaf.operators import merge, records
from sheaf.sources import store


def test_large_documents_are_read_like_small_ones(spark, tmp_path):
    odd = ["plain", 'quote " and \\ back', "line\nend\n    }\n    {", '  "records": [', "", "é日本 \U0001f600", "{}"]
    made = [{"id": f"r{i}", "title": odd[i % len(odd)], "rawText": odd[(i * 3) % len(odd)] * (i % 5), "patient": {"key": f"k{i}"}, "metadata": {"labValues": {"a": [{"b": 1}]}}} for i in range(300)]
    cards = [{"id": f"r{i}", "snippet": odd[i % len(odd)]} for i in range(0, 300, 3)]
    document = {"version": 1, "records": made, "indexCards": cards, "history": [{"id": "h", "records": [{"id": "x"}]}], "settings": {"a": {"id": "no"}}, "syncMetadata": {"visitedUrls": {"u": "t"}}}
    (tmp_path / "store.json").write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n")
    path = f"file://{tmp_path}/store.json"
    want = store.read_store(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # Blocks much smaller than the document cut it within records.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = store.read_large_store(spark, path)
        assert spark.read.option("lineSep", store.RECORD_END).text(path).rdd.getNumPartitions() > 10
        for a, b in zip(got, want, strict=True):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert got[0].count() == 300 and got[1].count() == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "odd.json").write_text(json.dumps({"records": [], "indexCards": [{"id": None}, {"x": 1}, 7]}, indent=2))
    assert [t.count() for t in store.read_large_store(spark, f"file://{tmp_path}/odd.json")] == [0, 0]
    assert [t.count() for t in store.read_large_store(spark, f"file://{tmp_path}/none.json")] == [0, 0]


def test_files_of_an_export_are_in_order(spark, sf, tmp_path):
    own = B.rec_events(spark, sf).withColumn("raw_text", F.when(F.col("seq") % 50 == 0, F.repeat(F.lit("some words. "), 600)).otherwise(F.col("raw_text")))
    manifest, fields, _ = jobs.export_job(own, derive=False, key=F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_ordered_export(manifest, fields, f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert len(files) > 1
    lines = [json.loads(x) for p in files for x in p.read_text().splitlines()]
    ids = [r["id"] for r in records.order_records(own).select("id").collect()]
    assert [x["type"] for x in lines] == ["manifest"] + ["record"] * len(ids) + ["chunk"] * (len(lines) - 1 - len(ids))
    assert [x["id"] for x in lines if x["type"] == "record"] == ids and "text" not in lines[1]
    chunks = [(x["id"], x["chunk_index"]) for x in lines if x["type"] == "chunk"]
    place = {i: n for n, i in enumerate(ids)}
    assert chunks == sorted(chunks, key=lambda c: (place[c[0]], c[1])) and len(chunks) > len(ids)
    assert [r["value"] for r in store.read_ordered_lines(spark, f"file://{tmp_path}/out").orderBy("number").collect()] == [x for p in files for x in p.read_text().splitlines()]


def test_cards_speak_for_their_records(spark, sf):
    own = spark.createDataFrame(B.rec_events(spark, sf).orderBy("seq").limit(4).collect(), B.rec_events(spark, sf).schema)
    ids = [r["id"] for r in own.orderBy("seq").collect()]
    cards = spark.createDataFrame([(ids[0], "told", "", "", "", ""), (ids[1], None, "", "", "", ""), ("gone", "orphan", "", "", "", ""), (ids[0], "zzz", "", "", "", "")], "id string, title string, record_type string, category string, date string, source_url string")
    told = {r["id"]: r for r in merge.with_cards(own, cards).collect()}
    known = {r["id"]: r for r in own.collect()}
    assert set(told) == set(ids) and told[ids[0]]["title"] == "told" and told[ids[0]]["date"] == known[ids[0]]["date"]
    assert all(told[i] == known[i] for i in ids[1:])


def test_jobs_take_steps(spark, sf):
    own = B.rec_events(spark, sf)
    errors = lambda rows: rows.where("title = 'error'")
    louder = lambda rows: rows.withColumn("title", F.upper("title"))
    _, fields, chunks = jobs.export_job(own, derive=False, steps=[errors, louder], key=F.col("patient.key"))
    want = own.where("title = 'error'").select("patient.key").distinct().count()
    assert fields.count() == want == chunks.count() and {r[0] for r in fields.select("title").distinct().collect()} == {"ERROR"}
    sections = jobs.report_job(own.limit(20), steps=[louder])
    assert sections.where(~F.col("section").rlike("^## [0-9]+\\. [A-Z]")).count() == 0 and sections.count() > 0
    pages = B.letter_pages(spark, sf).where("page_id < 40")
    done = jobs.ingest_job(pages, steps=[louder, lambda rows: rows.where("page_id is null") if "page_id" in rows.columns else rows.where("seq < 20")])
    assert done.count() == 20 and done.where("title <> upper(title)").count() == 0


def test_contained_titles_by_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "ab", "abc", "panel", "total", "x1", "lipid", "é"]
    title = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 6)))[: rng.randrange(1, 40)].strip() or "a"
    small, large = ({(g, title()) for g in "pq" for _ in range(150)} for _ in range(2))
    frame = lambda rows: spark.createDataFrame(sorted(rows), "g string, t string")
    got = {tuple(r) for r in merge.contained(frame(small), frame(large), ["g"], "t").collect()}
    assert got == {(g, s, x) for g, s in small for h, x in large if g == h and s in x}


def test_a_day_of_100000_titles(spark):
    who = F.struct(F.lit("p").alias("key"), F.lit("").alias("label")).alias("patient")
    day = lambda title, n: spark.range(n).select(F.concat(F.lit("i"), "id").alias("id"), who, F.lit("test-results").alias("category"), title.alias("title"), F.lit("January 5, 2024").alias("date"))
    stored = day(F.concat(F.lit("Stored panel number "), (F.col("id") * 2).cast("string"), F.lit(" end")), 100_000)
    derived = day(F.concat(F.lit("panel number "), F.col("id").cast("string"), F.lit(" end")), 100_000)
    left = merge.unmatched_derived(derived, stored)
    assert left.count() == 50_000 and left.where("cast(substr(id, 2) as long) % 2 = 0").count() == 0
