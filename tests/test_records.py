"""Small cases of the record operators."""

import itertools
import string
from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import clinical, dates, people, text, urls
from sheaf.jobs import pull
from sheaf.operators import chunks, frontier, labs, merge, pages, records
from sheaf.sources import store


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("seen", "iso"),
    [
        ("2024-03-05", "2024-03-05"), ("at 2024-03-05T10:00:00Z", "2024-03-05"), ("3/5/24", "2024-03-05"), ("3/5/1970 8:00", "1970-03-05"), ("3/5/70", "1970-03-05"), ("3/5/69", "2069-03-05"),
        ("Mar 5, 2024", "2024-03-05"), ("september 5,2024", "2024-09-05"), ("Monday March 5, 2024", ""), ("13/5/2024", ""), ("2/30/2024", ""), ("7.4/8", ""), ("1/2/1850", ""), ("", ""), (None, ""), ("2024-13-99", "2024-13-99"),
    ],
)
def test_clinical_dates(spark, seen, iso):
    assert one(spark, dates.clinical_date_iso(F.lit(seen).cast("string"))) == iso


@pytest.mark.parametrize(("said", "found"), [("pH 7.4/8 on 3/4/2024.", ""), ("on 3/4/2024 then", "3/4/2024"), ("13/4/2024 and 2/4/2024", "2/4/2024"), ("3/4/24; Mar 5, 2024", "Mar 5, 2024"), ("Mar 5 2024", "Mar 5 2024"), ("none", "")])
def test_extracted_dates(spark, said, found):
    assert one(spark, dates.extract_date(F.lit(said))) == found


@pytest.mark.parametrize(("name", "ok"), [("Ann Lee", True), ("ANN LEE", False), ("Serum Glucose", False), ("Ann Friday", True), ("Joan Visit", True), ("Ann Serum", True), ("Mary Panel", True), ("Zyrtec Daily", False), ("Results Only", False), ("Metabolic  Panel", False), ("Baby A B C D E", True), ("Baby A B C D E F", False), ("Log Out", False), ("Baby Girl Lee", True), ("ann lee", False), ("A B C D E F g", False), ("", False)])
def test_names(spark, name, ok):
    assert one(spark, people.is_person_name(F.lit(name))) is ok


def test_hash(spark):
    def plain(s):
        h = 5381
        for ch in s:
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(ch)
        digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out

    for s in ("", "a", "Ann Lee", "Élan\nzwei", "x" * 500):
        assert one(spark, text.text_hash(F.lit(s))) == plain(s)


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit("  a \t b\r\n\n  c "))) == "a b\nc"
    assert one(spark, text.labelize(F.lit("test-results"))) == "Test Results"
    assert one(spark, text.first_nonempty(F.lit(None).cast("string"), F.lit(""), F.lit(" "))) == " "
    assert one(spark, clinical.distinct_lines(F.lit("A b\nc\na, B\n--\n--"))) == "A b\nc\n--\n--"
    assert one(spark, clinical.strip_menu(F.lit("Your menu Log out Progress Notes by X"))) == "Progress Notes by X"


def test_urls(spark):
    u = "https://h.example/p?b=2&utm_x=1&a=1&viewer=9&fromDate=3#f"
    assert one(spark, urls.canonical_source(F.lit(u))) == "https://h.example/p?a=1&b=2"
    assert one(spark, urls.canonical_source(F.lit("not a url"))) == "not a url"
    assert one(spark, urls.source_host(F.lit("http://h.example:81/x"))) == "h.example:81"
    assert one(spark, urls.source_host(F.lit("x y"))) == "invalid-url"
    assert one(spark, urls.route_identity(F.lit("HTTPS://H.example/A/?orderid=2&view=1"), F.lit("visits"), F.lit(""))) == "https://h.example||visits|/a|orderid=2"


@given(st.text(alphabet="ab. \n#", max_size=300), st.integers(5, 60), st.integers(-1, 50))
def test_chunks_cover_the_text(t, size, overlap):
    t = t.strip()
    made = chunks.cuts(t, size, overlap)
    o = min(overlap if overlap > 0 else chunks.OVERLAP, size - 1)
    if not t:
        assert made == []
        return
    assert made[0][0] == 0 and made[-1][1] == len(t)
    for (a, b), (c, _) in zip(made[:-1], made[1:], strict=True):
        assert 0 < b - a <= size
        assert c == (b - o if b - o > a else b)


def test_chunk_boundaries():
    t = "x" * 60 + ".\n\n" + "y" * 20 + " " + "z" * 60
    assert chunks.cuts(t, 100, 10)[0] == (0, 63)
    assert chunks.cuts("a" * 250, 100, 10)[0] == (0, 100)


def test_lab_groups():
    note = "Recent Results\nCBC panel\nCollection Time: 03/04/24 8:15 AM\nWBC 5 K/uL\nBlood gas\nCollection Time: 03/05/24 9:00 AM\npH 7.3 Low\nAssessment\nCollection Time: none"
    assert [(g["title"], g["collection_time"], len(g["lines"])) for g in labs.lab_groups(note)] == [("CBC panel", "03/04/24 8:15 AM", 3), ("Blood gas", "03/05/24 9:00 AM", 3)]
    assert labs.lab_groups("Collection Time: 03/04/24") == []
    assert labs.components("Sodium\nValue 7 mg/dL High\nNormal range: 1 - 5\nPotassium value 3") == [
        {"name": "Sodium", "value": "7", "units": "mg/dL", "reference_range": "1 - 5", "flag": "High"},
        {"name": "Potassium", "value": "3", "units": "", "reference_range": "", "flag": ""},
    ]
    assert labs.split_medications("Aa 5 mg\nTake one\nBb 2 mg\nTake two\nBb 2 mg") == ["Aa 5 mg\nTake one", "Bb 2 mg\nTake two\nBb 2 mg"]


def test_pages():
    html = "<body><script>no</script><h1>T &amp; U</h1><ul><li>a<li>b</ul><p>x<br>y<p>x<br>y<a href='/q?x=1#z'>go</a></body>"
    assert [(b["tag"], b["text"]) for b in pages.page_blocks(html)] == [("h1", "T & U"), ("li", "a"), ("li", "b"), ("p", "x\ny"), ("p", "x\nygo")]
    assert pages.page_blocks(None) == [] and pages.page_blocks("plain <b>text</b>") == [{"tag": "main", "text": "plain text"}]
    page = "<nav><li>menu</li></nav><main><div class='ResultCard' aria-label='Sodium'>7 mg</div><li title='x'>x y</li></main><li>foot</li>"
    assert [(b["tag"], b["text"]) for b in pages.page_blocks(page)] == [("card", "7 mg\nSodium"), ("li", "x y")]


def test_links(spark):
    html = "<a href='/visit?id=1'>A</a><a href='#x'>visit</a><a href='http://h.example/p#x'>visit</a><a href='http://o.example/visit'>visit</a><button formaction='/notes/1' aria-label='Open note'></button><button>view</button><a href='/about'>us</a><a href='/visit'>Print visit</a>"
    frame = spark.createDataFrame([(1, "http://h.example/p", html), (2, None, html), (3, "http://[bad", html)], "page_id long, url string, html string")
    assert [(r["text"], r["href"]) for r in pages.extract_links(frame).where("page_id = 1").collect()] == [("A", "http://h.example/visit?id=1"), ("Open note", "http://h.example/notes/1")]


def test_splits(spark):
    own = lambda t, c: one(spark, pages.split_texts(F.lit(t), F.lit(c)))
    assert own("First visit\n3/4/2024\nall\nSecond one\nMar 5, 2024\nwell", "letters") == ["First visit\n3/4/2024\nall", "Second one\nMar 5, 2024\nwell"]
    note = "Progress Notes by A\n3/4/2024\nPlan: rest\nNext\n3/5/2024\nx"
    assert own(note, "visits") == [note]
    assert own("Acetaminophen tablet\nTake one\nIbuprofen capsule\nTake two", "medications") == ["Acetaminophen tablet\nTake one", "Ibuprofen capsule\nTake two"]


def test_categories_and_scopes():
    assert frontier.normalize_categories(["Visits, letters", "visits"]) == ["letters", "visits"]
    with pytest.raises(ValueError, match="unknown"):
        frontier.normalize_categories(["x"])
    assert frontier.scope_key(" Ann  Lee", categories=["b", "A", "b"], query="Q") == "ann lee|a,b||q"
    assert frontier.scope_key(default_label="D") == "d|||" and frontier.scope_key("p", default_label="D") == "p|||"


RECORD = "id string, source_url string, title string, value double, seq long"


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("1", "s", "a", 1.0, 1), ("2", "s", "b", 1.0, 1), ("3", "t", "c", 1.0, 1)], RECORD)
    new = spark.createDataFrame([("1", "s", "a", 2.0, 2), ("4", "s", "d", 1.0, 2)], RECORD)
    merged = merge.upsert(old, new)
    assert {r["id"]: r["delta"] for r in merged.collect()} == {"1": "updated", "2": "deleted", "3": "untouched", "4": "inserted"}
    store_ = merged.where("delta <> 'deleted'").drop("delta")
    assert {r["delta"] for r in merge.upsert(store_, new).collect()} == {"unchanged", "untouched"}
    gone = merge.upsert(old, new.limit(0), spark.createDataFrame([("s",)], "source_url string"))
    assert {r["id"] for r in gone.where("delta = 'deleted'").collect()} == {"1", "2"}


def test_dedupe_is_the_same_in_any_order_and_partitioning(spark, sf):
    from sheaf import bindings

    own = bindings.rec_events(spark, sf)
    expected = {(r["id"], r["seq"]) for r in records.dedupe_best(own).select("id", "seq").collect()}
    for n in (1, 7, 50):
        again = own.orderBy(F.desc("id")).repartition(n)
        assert {(r["id"], r["seq"]) for r in records.dedupe_best(again).select("id", "seq").collect()} == expected


def test_pull_ranges(spark):
    assert pull.recent_range(3, end="2024-03-01") == ("2024-02-28", "2024-03-01")
    assert pull.recent_range(everything=True) == ("", "")
    assert pull.since_last_pull("2024-03-05", "2024-03-01") == ("2024-03-01", "2024-03-01")
    assert pull.since_last_pull("", "2024-03-10", 3) == ("2024-03-08", "2024-03-10")
    assert pull.advance_mark("s", "2024-01-01", 5, "safe") == (True, "")
    assert pull.advance_mark("s", "2024-01-01", 0, "safe") == (False, "nothing_exported")
    assert pull.advance_mark("s", "2024-01-01", 5, "unsafe") == (False, "freshness_unsafe")
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    pull.assert_fresh("2024-01-01T00:00:00Z", now)
    for bad in (None, "x", "2023-12-30T00:00:00Z"):
        with pytest.raises(ValueError):
            pull.assert_fresh(bad, now)
    cards = spark.createDataFrame([("1", "3/1/2024"), ("2", "2030-01-01"), ("3", "")], "id string, date string")
    assert pull.resolve_range(cards, "2024-06-01", latest=True) == ("2024-03-01", "2024-03-01")
    with pytest.raises(ValueError):
        pull.resolve_range(cards, "2024-06-01", latest=True, everything=True)


def test_store(spark, tmp_path):
    records_, cards = store.read_store(spark, f"file://{tmp_path}/none.json")
    assert records_.count() == 0 and cards.count() == 0
    (tmp_path / "store.json").write_text(store.store_document([{"id": "1", "rawText": "t", "patient": {"key": "k"}, "extractedAt": "2024-01-01T00:00:00Z"}, {"title": "no id"}], []))
    records_, cards = store.read_store(spark, f"file://{tmp_path}/store.json")
    row = records_.first()
    assert records_.count() == 1 and row["raw_text"] == "t" and row["patient"]["key"] == "k" and row["extracted_at"].year == 2024
    (tmp_path / "odd.json").write_text('{"records": 7}')
    assert store.read_store(spark, f"file://{tmp_path}/odd.json")[0].count() == 0


def test_generations_and_marks(spark, tmp_path):
    path = f"file://{tmp_path}/marks"
    assert store.read_pull_state(spark, path).count() == 0
    kind = "scope_key string, last_clinical_date string, last_record_count long, updated_at timestamp"
    for scope, day in (("a", "2024-01-01"), ("b", "2024-01-02"), ("a", "2024-01-03")):
        store.write_pull_state(spark, path, spark.createDataFrame([(scope, day, 1, None)], kind))
    assert {(r[0], r[1]) for r in store.read_pull_state(spark, path).collect()} == {("a", "2024-01-03"), ("b", "2024-01-02")}


def test_bad_export_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type": "record"}\n\n{bad\n')
    with pytest.raises(ValueError, match="line 2"):
        store.read_jsonl_export(spark, f"file://{tmp_path}/x.jsonl")
    assert store.read_jsonl_export(spark, f"file://{tmp_path}/x.jsonl", fail=False)["record"].count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from sheaf.streaming.merge import read_records, stream_merge

    rows = spark.createDataFrame([(str(i % 20), f"https://h.example/{i % 5}", f"t{i}", float(i), i) for i in range(60)], RECORD)
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(RECORD).parquet(f"file://{tmp_path}/in")
    stream_merge(stream, f"file://{tmp_path}/store", f"file://{tmp_path}/checkpoint").awaitTermination()
    found = {tuple(r) for r in read_records(spark, f"file://{tmp_path}/store").select("id", "title").collect()}
    assert found == {tuple(r) for r in merge.latest_in_batch(rows).select("id", "title").collect()}


def test_batches_make_the_same_store_as_upserts(spark, tmp_path, monkeypatch):
    """A log of changes, put together every few batches, against whole upserts; a batch that comes again changes nothing."""
    from sheaf.streaming import merge as log

    monkeypatch.setattr(log, "PARTS", 3)
    path, whole = f"file://{tmp_path}/log", None
    for n in range(9):
        rows = [(str((n * 7 + i) % 23), f"https://h.example/{(n + i) % 6}", f"t{n}-{i}", float(n), n * 10 + i) for i in range(6)]
        batch = spark.createDataFrame(rows, RECORD)
        for _ in range(2):
            log.merge_batch(spark, path, batch, n)
        incoming = merge.latest_in_batch(batch)
        whole = incoming if whole is None else merge.upsert(whole, incoming).where("delta <> 'deleted'").drop("delta")
        whole = spark.createDataFrame(whole.collect(), RECORD)
        assert sorted(map(tuple, log.read_records(spark, path).collect())) == sorted(map(tuple, whole.collect()))
    assert len(log._log(spark, path)[1]) <= 3


def test_a_pointer_that_was_not_finished_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert store.read_generation(spark, path, "t") is None
    store.write_generation({"t": spark.range(3)}, path)
    (tmp_path / "store/current/000000000001").mkdir(parents=True)
    assert store.read_generation(spark, path, "t").count() == 3
    store.write_generation({"t": spark.range(4)}, path)
    assert store.read_generation(spark, path, "t").count() == 4


def test_sync_state(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"syncMetadata": {"runs": {"a": {"in_progress": false, "freshness_safe": true, "error_count": 2}}, "visitedUrls": {"u": "2024-01-01T00:00:00Z"}, "canonicalCoverage": 7}, "settings": {"x": 1}, "history": [{"e": 1}]}')
    got = store.read_sync_state(spark, f"file://{tmp_path}/s.json")
    assert got["runs"].first()["error_count"] == 2 and got["visited"].first()["url_key"] == "u" and got["coverage"].count() == 0 and got["settings"].first()["value"] == "1" and got["history"].count() == 1
    assert all(t.count() == 0 for t in store.read_sync_state(spark, f"file://{tmp_path}/none.json").values())


def test_labs_of_notes_and_lists():
    assert labs.lab_groups("Seen\nCollection Time: 03/04/24 8:15 AM\nWBC 5 K/uL") == []
    assert [c["name"] for c in labs.components("Sodium\nNormal\nValue 7 mg/dL\nCollected on 3/4/2024\nFinal result")] == ["Sodium"]
    assert labs.split_medications("Acetaminophen tablet\nTake one\nIbuprofen capsule\nTake two") == ["Acetaminophen tablet\nTake one", "Ibuprofen capsule\nTake two"]


def test_nothing_is_planned_behind_a_stop(spark):
    rows = [(f"u{i}", 1, i, True, i in (1, 2, 5), 1) for i in range(8)]
    frame = spark.createDataFrame(rows, "url string, priority int, pos int, strict boolean, broad boolean, expected int")
    out = [(r["url"], r["stopped"]) for r in frontier.plan(frame, 6, max_broad=1).orderBy("position").collect()]
    assert out == [("u0", ""), ("u1", ""), ("u2", "max_broad")]
    assert frontier.plan(frame, 6, max_records=3).where("stopped = ''").count() == 3


@pytest.fixture
def many_ranges(spark):
    """Range bounds from small samples, and small partitions kept apart, as large tables have it."""
    own = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


def test_global_numbers_above_the_sample_size(spark, many_ranges):
    n = 50_000
    rows = spark.range(n).select("id", F.xxhash64("id").alias("key"))
    found = [r["number"] for r in records.number_globally(rows, ["key"]).orderBy("key").select("number").collect()]
    assert found == list(range(1, n + 1))


def test_numbers_of_a_scope_with_most_rows(spark, many_ranges):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, (F.col("id") % 70).cast("string")).when(F.col("id") % 10 != 1, "hot").alias("scope"), F.xxhash64("id").alias("key"))
    out = records.number_sections(rows, ["scope"], [F.col("key").desc()])
    places = {}
    for r in sorted(out.select("id", "scope", "key", "number", F.spark_partition_id().alias("task")).collect(), key=lambda r: -r["key"]):
        places.setdefault(r["scope"], []).append((r["number"], r["task"]))
    assert sum(map(len, places.values())) == 20_000 and None in places
    assert all([n for n, _ in own] == list(range(1, len(own) + 1)) for own in places.values())
    assert len({task for _, task in places["hot"]}) > 1


def colliding_texts():
    """Two texts of one title whose ids' hash, with the title before them, is the same."""
    title, seen = "Follow up of the visit", {}
    start = f"{title}\n{title}\nAll is well with "
    for a, b, c in itertools.product(string.ascii_letters + string.digits, repeat=3):
        h = 5381
        for ch in start + a + b + c:
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(ch)
        body = f"{title}\nAll is well with {a}{b}{c}"
        if h in seen:
            return seen[h], body
        seen[h] = body
    raise AssertionError("no collision")


def test_ingest_keeps_texts_whose_ids_collide(spark):
    from sheaf.jobs.export import ingest_job

    one_, two = (t.replace("\n", "<br>") for t in colliding_texts())
    url = "https://h.example/app/letters/"
    page = "page_id long, url string, html string"
    first = ingest_job(spark.createDataFrame([(1, url + "1", f"<p>{one_}</p>"), (2, url + "2", f"<p>{two}</p>")], page))
    rows = first.collect()
    assert len({r["id"] for r in rows}) == 1 and {r["raw_text"] for r in rows} == set(colliding_texts())
    same_page = ingest_job(spark.createDataFrame([(1, url + "1", f"<article>{one_}</article><article>{two}</article>")], page))
    assert {r["raw_text"] for r in same_page.collect()} == set(colliding_texts())
    stored = spark.createDataFrame(rows, first.schema).drop("delta")
    again = ingest_job(spark.createDataFrame([(3, url + "2", f"<p>{one_}</p>"), (4, url + "1", "")], page), stored).collect()
    assert {r["raw_text"]: r["delta"] for r in again} == {colliding_texts()[0]: "updated", colliding_texts()[1]: "deleted"}


def test_pages_without_an_address_are_no_one_source(spark):
    rows = spark.createDataFrame([("1", None, "a", 1.0, 1), ("2", "", "b", 1.0, 2), ("2", "", "c", 1.0, 3), ("3", "s", "d", 1.0, None), ("4", "s", "e", 1.0, 4), ("5", "s", "f", 1.0, 5)], RECORD)
    assert {(r["id"], r["title"]) for r in merge.latest_in_batch(rows).collect()} == {("1", "a"), ("2", "c"), ("3", "d"), ("5", "f")}


def test_every_record_has_a_place(spark, sf):
    from sheaf import bindings, queries

    places = [r["place"] for r in queries.t1_place_records(spark, sf).collect()]
    assert sorted(places) == list(range(1, bindings.table(spark, sf, "events").count() + 1))


def test_notes_with_all_line_items(spark, sf):
    from sheaf import bindings

    items = bindings.table(spark, sf, "lineitem").join(bindings.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count()
    groups = F.size(F.split("raw_text", "Collection Time: ")) - 1
    assert bindings.note_text(spark, sf, None).agg(F.sum(groups)).first()[0] == items


@pytest.mark.parametrize(
    ("said", "name"),
    [("Welcome, Ann Lee!", "Ann Lee"), ("Hello, Main Menu", ""), ("Hi Ann! I'm here to help", "Ann"), ("BBaby Lee Park", "Baby Lee Park"), ("BBoy Lee", "Boy Lee"), ("XBaby Lee Park", "Baby Lee Park"), ("Viewing: Office Visit", ""), ("Account Settings", ""), ("Patient: Ann Friday", ""), ("now viewing Joan Visit's chart", "Joan Visit")],
)
def test_whose_page_it_is(spark, said, name):
    assert one(spark, people.infer_name(F.lit(said))) == name


@pytest.mark.parametrize(
    ("said", "substance"),
    [
        ("Notes from Care Team\nChief Complaint\nFever and flank pain since Monday.\nInfant in NICU.\nUrine dip positive", True), ("Chief Complaint", True), ("Flank pain", True), ("Infant", True), ("on room air", True),
        ("Plan of the week", False), ("Plan : rest", True), ("Privacy policy", False), ("", False), (None, False),
    ],
)
def test_notes_without_colons(spark, said, substance):
    text = F.lit(said).cast("string")
    shell = clinical.is_invalid_shell(F.lit("visits"), F.lit("visit-note"), F.lit("Notes from Care Team"), F.concat(F.lit("Notes from Care Team\n"), F.coalesce(text, F.lit(""))), F.lit(""))
    assert one(spark, clinical.has_substance(text)) is substance and one(spark, shell) is not substance


def test_frames_by_their_titles_and_sizes(spark):
    shell = lambda title, text, kind="visit", url="", category="visits": one(spark, clinical.is_invalid_shell(F.lit(category), F.lit(kind), F.lit(title), F.lit(text), F.lit(url)))
    assert shell("Notes from Care Team", "Notes from Care Team")
    assert not shell("Progress Notes", "Notes from Care Team", "visit-note")
    assert not shell("Visit", "Notes from Care Team") and shell("Visit", "Notes from Care Team", "visit-note")
    assert shell("Visit", "Load more past visits", url="https://p.example.org/app/Visits") and not shell("Visit", "Load more past visits", category="", url="https://p.example.org/app/Visits")
    assert shell("Visit", "x" * 50_001) and not shell("Visit", "x" * 50_000) and not shell("Visit", "x" * 60_000 + " infant")


def test_only_whole_lines_start_a_footer(spark):
    said = "Privacy policy reviewed with patient\nAssessment: stable\nPlan: rest\nFAQs\nPrivacy Policy\nTerms and Conditions\nPlan: none"
    assert one(spark, clinical.trim_boilerplate(F.lit(said), F.lit("visits"))) == "Privacy policy reviewed with patient\nAssessment: stable\nPlan: rest\nFAQs"
    assert one(spark, clinical.trim_boilerplate(F.lit(said), F.lit("letters"))).endswith("FAQs\nPlan: none")


def test_page_parts():
    from sheaf.operators.elements import page_parts

    said = page_parts('<body><main id="x"><section class="y"><p>one<p>two</section><iframe srcdoc="&lt;p&gt;inner &amp;amp; deep&lt;/p&gt;"></iframe><template shadowrootmode="open"><b>shade</b></template><template>no</template><script>x</script></main><p>out</p></body>')
    assert said["main"] == "one\ntwo" and said["page"] == "one\ntwo\nout" and said["blocks"] == ["one\ntwo"] and said["linked"] == []
    assert said["deep"] == ["one\ntwo\ninner & deep\nshade", "one\ntwo\ninner & deep\nshade\nout"]
    nested = page_parts("<div>" * 5000 + "<li>a" + "</div>" * 3)
    assert nested["blocks"] == ["a"] and page_parts(None) == {"main": "", "page": "", "deep": ["", ""], "linked": [], "blocks": []}
    far = page_parts('<div>Jan 5, 2024<div><div><div><div><div><div><div><a href="/testresults?x" aria-label="Glucose">Lab</a></div></div></div></div></div></div></div></div>')
    assert far["linked"] == ["Glucose\nLab"]
    near = page_parts(f'<ul><li><a href="/testresults?x">Glucose</a><p>Jan 5, 2024</p><p>{"x" * 2000}</p></li></ul>')
    assert near["linked"] == ["Glucose\nGlucose"]


def test_blocks_fall_back_to_the_whole_page(spark):
    from sheaf.operators.elements import record_blocks

    rows = [(1, "https://p.example.org/app/letters", "<main><li>Log out</li><p>Dear all</p></main>"), (2, "https://p.example.org/home", "<li>Letter of Jan 5, 2024 about it</li>"), (3, None, None), (4, "https://p.example.org/app/visits", "<main><article>Office visit on Jan 5, 2024 with staff</article></main>"), (5, None, "<li>Result of Jan 5, 2024: value 7</li><li>Result of Jan 5, 2024: value 7</li>")]
    got = {(r["page_id"], r["pos"]): r["text"] for r in record_blocks(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, 0): "Log out\nDear all", (4, 0): "Office visit on Jan 5, 2024 with staff", (5, 0): "Result of Jan 5, 2024: value 7"}


def test_headers_over_notes(spark):
    from sheaf.operators.elements import enrich_notes, note_header, page_header

    text = "Menu\nNotes from Care Team\nProgress Notes by Ann Lee\nSigned Jan 5, 2024\nFiled today\nother"
    assert one(spark, page_header(F.lit(text))) == "Notes from Care Team\nProgress Notes by Ann Lee\nSigned Jan 5, 2024\nFiled today"
    assert one(spark, page_header(F.lit("a\nb"))) == "" and one(spark, page_header(F.lit(None).cast("string"))) == ""
    assert one(spark, note_header(F.lit("Signed Jan 5, 2024\nPlan of Care by Ann\nx\nthe note begins"), F.lit("the note begins"))) == "Plan of Care by Ann\nSigned Jan 5, 2024"
    rows = [("p:visits:undated:1", "visit-note", "Visit", "", "t", text), ("p:visits:1/2/2020:2", "visit-note", "Chief Complaint", "1/2/2020", "t", text), ("p:visits:1/2/2020:3", "visit-note", "Real title", "1/2/2020", "t", text), ("p:visits:undated:4", "visit", "Visit", "", "t", text), ("p:visits:undated:5", "visit-note", "Real", "", "t", text), (None, "visit-note", None, None, None, None)]
    got = [(r["id"], r["title"], r["date"]) for r in enrich_notes(spark.createDataFrame(rows, "id string, record_type string, title string, date string, raw_text string, header string")).collect()]
    assert got == [("p:visits:Jan 5, 2024:1", "Progress Notes by Ann Lee", "Jan 5, 2024"), ("p:visits:Jan 5, 2024:2", "Progress Notes by Ann Lee", "Jan 5, 2024"), ("p:visits:1/2/2020:3", "Real title", "1/2/2020"), ("p:visits:undated:4", "Visit", ""), ("p:visits:Jan 5, 2024:5", "Real", "Jan 5, 2024"), (None, None, None)]
