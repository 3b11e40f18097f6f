"""What only shows on larger tables: keys past a million, one row group, many rows of one task."""

from datetime import datetime

from pyspark.sql import functions as F

from sheaf import bindings as B
from sheaf import queries as Q
from sheaf.functions import urls
from sheaf.jobs.crawl import crawl_job
from sheaf.operators import chunks, elements, frontier, labs, pages, records
from sheaf.sources import store
from sheaf.sources.shared import BATCH_BYTES


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_attachments_in_order_of_lines_whatever_the_parts(spark, tmp_path):
    spark.createDataFrame([(1, 1, "F", datetime(2024, 1, 5), "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Ann")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, 1_500_000), (1, 2, 3)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert Q.QUERIES["p29_attachments"](spark, str(tmp_path)).first()["summary"] == "Attachments: Line 1, Line 2"


def test_a_filter_on_headers_reads_pages_once(spark, sf):
    blocks = elements.record_blocks(B.portal_pages(spark, sf)).where("header <> ''")
    plan = optimized(elements.enrich_notes(blocks.select(F.lit("k:visits:undated:1").alias("id"), F.lit("").alias("date"), F.lit("Visit").alias("title"), F.lit("visit-note").alias("record_type"), F.lit("text").alias("raw_text"), "header")))
    assert plan.count("ArrowEvalPython") == 1
    # What a header says is looked for once for all columns that need it.
    assert plan.count("signed\\s+((?:jan") == 1


def test_small_tables_are_rendered_on_all_cores(spark, sf):
    assert B.portal_pages(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_running_sums_need_no_python_workers(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("kind"), F.lit(2).cast("long").alias("n"))
    totals = records.running_totals(rows, ["id"], "n", "before", scope="kind")
    assert "MapInArrow" not in optimized(totals)
    assert totals.where("before = 2 * floor(id / 3)").count() == 1000


def test_a_store_document_in_several_files(spark, tmp_path):
    record = lambda i: f'    {{\n      "id": "{i}"\n    }}'
    (tmp_path / "part-0").write_text('{\n  "version": 1,\n  "records": [\n' + record("a") + ",\n")
    (tmp_path / "part-1").write_text(record("b") + ",\n" + record("c") + '\n  ],\n  "indexCards": [\n')
    (tmp_path / "part-2").write_text(record("d") + '\n  ],\n  "history": [\n    {\n      "id": "h"\n    }\n  ]\n}\n')
    made, cards = store.read_large_store(spark, str(tmp_path))
    assert [sorted(r["id"] for r in t.collect()) for t in (made, cards)] == [["a", "b", "c"], ["d"]]


def test_rounds_make_what_earlier_runs_covered_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    address = lambda n: f"{B.PORTAL}/app/test-results" if n == 0 else f"{B.PORTAL}/app/test-results/details?eorderid={n}"
    site = spark.createDataFrame([(n, address(n), f'<a href="{address(n + 1)}">Result details</a>') for n in range(4)], "page_id long, url string, html string")
    coverage = spark.createDataFrame([("none",)], "identity_hash string").select(counted("identity_hash").alias("identity_hash"))
    seeds = frontier.seeds(spark.range(1).select(F.lit(B.PORTAL).alias("base_url")), categories=["test-results"])
    run = crawl_job(site, seeds, coverage=coverage, expected_origin=B.PORTAL)
    assert run.rounds == 5 and run.visits.where("status = 'visited'").count() == 4
    assert made.value == 1


def test_texts_go_to_python_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.createDataFrame([("a", "text", f"{B.PORTAL}/app/letters/1", 0)], "id string, text string, url string, pos int")
    for use in (chunks.chunk_text, labs.lab_components, lambda r: pages.build_records(r.withColumnRenamed("id", "page_id"))):
        spark.conf.set(setting, "64m")
        use(rows)
        assert spark.conf.get(setting) == BATCH_BYTES


def test_arrivals_are_files_that_many_tasks_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "ARRIVAL_ROWS", 50)
    made = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.floor(F.col("id") / 10).alias("seq"))
    assert B.arrivals(made, f"file://{tmp_path}/pages", 4) == (5, 20)
    assert spark.read.parquet(f"file://{tmp_path}/pages").count() == 1000


def test_checkpoints_of_several_files_give_the_same_rows(spark, monkeypatch):
    own = lambda: sorted(Q.QUERIES["s1_bounded_checkpoints"](spark, "/root/testdata/sf0.01").collect())
    monkeypatch.setattr(B, "ARRIVAL_ROWS", 1000)
    several = own()
    assert len(several) == 2000 and all(r["bounded"] for r in several)
    monkeypatch.setattr(B, "ARRIVAL_ROWS", 250_000)
    assert several == own()


def test_only_addresses_that_may_differ_are_parsed(spark):
    plan = optimized(spark.range(1).select(F.col("id").cast("string").alias("u")).select(urls.source_url_key(F.col("u")).alias("s"), urls.is_past_visit_detail(F.col("u")).alias("p"), urls.visit_key(F.col("u")).alias("v")))
    # Each is told by a search in the text first.
    assert plan.lower().count("case when contains(") == 3
    odd = ["https://p.example.org/APP/Visits/Past-Details?csn=5#top", "https://p.example.org/app/visits/note?csn=5", "https://p.example.org/x?next=/app/visits/past-details&csn=5", "https://p.example.org/x#/app/visits/note", "not an address # at all", "/app/visits/note?csn=1", "https://P.example.org/app/visits/past-details", "", None]
    got = spark.createDataFrame([(x, i) for i, x in enumerate(odd)], "u string, i int").select("i", urls.source_url_key(F.col("u")), urls.is_past_visit_detail(F.col("u")), urls.visit_key(F.col("u"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("https://p.example.org/APP/Visits/Past-Details?csn=5", True, "https://p.example.org/visit-csn/5"),
        ("https://p.example.org/app/visits/note?csn=5", False, "https://p.example.org/visit-csn/5"),
        ("https://p.example.org/x?next=/app/visits/past-details&csn=5", False, ""),
        ("https://p.example.org/x", False, ""),
        ("not an address # at all", False, ""),
        ("/app/visits/note?csn=1", False, None),
        ("https://P.example.org/app/visits/past-details", True, ""),
        ("", False, ""),
        ("", False, ""),
    ]
