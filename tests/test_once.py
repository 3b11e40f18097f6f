"""Steps that many queries share do their work once a row: what is searched, compared and read, and that results stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import clinical, dates, text
from sheaf.operators import labs, merge


def test_months_are_not_compared_name_by_name(spark):
    rows = spark.createDataFrame([("May 3, 2021",), ("Feb 29, 2023",), ("2/29/24",), ("13/1/2020",), (" Sept  5, 1899",), (None,)], "t string")
    plan = rows.select(dates.clinical_date_iso(F.col("t")), dates.group_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
    assert [r[0] for r in rows.select(dates.clinical_date_iso(F.col("t"))).collect()] == ["2021-05-03", "", "2024-02-29", "", "", ""]
    assert [r[0] for r in rows.select(dates.group_date(F.col("t"))["display"]).collect()] == ["May 3, 2021", "February 29, 2023", "February 29, 2024", "undefined 1, 2020", "September 5, 1899", ""]


def test_lines_are_squashed_in_the_whole_text(spark):
    rows = spark.createDataFrame([("a  b\r\n 　\n\tc\x85d ",), ("plain\ntext",), ("\n",), ("",), (None,), ("x \n\n y",)], "t string")
    plan = rows.select(text.normalize_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    assert [r[0] for r in rows.select(text.normalize_text(F.col("t"))).collect()] == ["a b\nc d", "plain\ntext", "", "", "", "x\ny"]
    assert [r[0] for r in rows.select(text.lines(F.col("t"))).collect()] == [["a b", "c d"], ["plain", "text"], [], [], [], ["x", "y"]]


def test_a_title_is_inferred_once(spark):
    rows = spark.createDataFrame([("Results\nGlucose\nValue 7",), ("Value 7",), ("",)], "t string")
    made = rows.select(clinical.infer_title(F.col("t"), F.lit("test-results"), F.lit("Ann")).alias("title"))
    # That of the chosen title, and that of result rows.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Date\\s+Value\\s+Normal\\s+Range\\b, ,") == 2
    assert [r[0] for r in made.collect()] == ["Glucose", "Value 7", "test-results"]


def test_hashes_in_batches_are_those_of_columns(spark):
    own = ["", "a", "grüße", "line\nline", "x" * 5000, *(f"text {i} of {'y' * (i % 90)}" for i in range(300))]
    rows = spark.createDataFrame([(x,) for x in own], "t string")
    both = rows.select(text.text_hash(F.col("t")).alias("a"), text.text_hash_batched(F.col("t")).alias("b")).collect()
    assert len(both) == len(own) and all(r.a == r.b for r in both)


def test_a_line_of_lab_texts_is_read_once(monkeypatch):
    seen = []
    own = labs.value_parts
    monkeypatch.setattr(labs, "value_parts", lambda said: seen.append(said) or own(said))
    made = [labs.components("Sodium\nNormal range: 1 - 25 units\nValue 918273 units High") for _ in range(50)]
    assert made == [[{"name": "Sodium", "value": "918273", "units": "units", "reference_range": "1 - 25 units", "flag": "High"}]] * 50
    assert len(seen) == 1


def test_derived_rows_are_not_made_to_see_that_nothing_matches(spark):
    kind = "id string, category string, title string, date string, patient struct<key:string,label:string>"
    stored = spark.createDataFrame([("v", "visits", "Visit", "1/5/2024", ("p", "p"))], kind)
    derived = stored.where(F.raise_error(F.lit("derived")).isNull())
    merge.unmatched_derived(derived, stored)
    known = spark.createDataFrame([("l", "test-results", "Panel", "1/5/2024", ("p", "p"))], kind)
    some = spark.createDataFrame([("d", "test-results", "Panel total", "1/5/2024", ("p", "p")), ("e", "test-results", "Other", "1/5/2024", ("p", "p"))], kind)
    assert [r.id for r in merge.unmatched_derived(some, known).collect()] == ["e"]


def test_a_link_is_classified_once(spark):
    """However often it stands there: a filter on classes, and joins by identities, do not look at it again."""
    from sheaf.operators import frontier

    base = "https://p.example.org"
    detail, other, trend = f"{base}/app/test-results/details?eorderid=", f"{base}/clinical/other?lrpid=", f"{base}/app/test-results/past-result-details?orderid="
    made = [(f"{detail}1&view=full", "Details", "test-results", 7), (f"{detail}1", "Details", "test-results", 9), (f"{detail}1", "Details", "test-results", 3), (f"{detail}1", "View trends", "test-results", 1)]
    made += [(f"{detail}2", "Details", "test-results", None), (f"{detail}2", "Details", "test-results", 2), (f"{detail}2", "Details", "test-results", 1)]
    made += [(f"{other}3", "More", "visits", 5)] * 3 + [(f"{trend}4", "Compare", "test-results", 1), (None, "x", "visits", 1), (f"{detail}5", "Details", "test-results", 4), (f"{detail}6", "Details", "test-results", 4)]
    links = spark.createDataFrame(made, "url string, text string, category string, pos int")
    covered = frontier.classified(links.where(F.col("url").endswith("=5"))).select("identity_hash")
    seen = spark.createDataFrame([(f"{detail}6",)], "url_key string")
    found = frontier.frontier(links, covered, seen, expected_origin=base)
    got = sorted((r["url"], r["pos"], r["route"]["admission"], r["admissible"], r["seen"]) for r in found.collect())
    want = [(f"{detail}1", 3, "strict", 3, False), (f"{detail}2", None, "strict", 3, False), (f"{detail}6", 4, "strict", 1, True), (f"{other}3", 5, "exhaustive", 3, False)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("credible_unrecognized_clinical_route") == 1


def test_cues_of_names_are_looked_for_where_their_words_are(spark, monkeypatch):
    """A text without a cue's words is not searched for it, and each cue's words stand in all that it fits."""
    from sheaf.functions import people

    name = "Mary Ann Lee"
    said = [f"You're VIEWING {name}", f"Today's visits({name})", f"x ({name})", f"WELCOME {name}", f"Hi {name}! I'm here", f"Notification for {name}", f"viewing {name}’s chart", f"Proxy for {name}", f"Account: {name}", f"records for {name}", f"PATIENT {name}", f"{name}'s Records", f"{name}'s CHART"]
    odd = [f"a\r\n\n Patient:   {name}  \n", f"Patient: {name}", "JBoy Jones", "no cue", "", None]
    rows = spark.createDataFrame([(t,) for t in said + odd], "t string")
    made = rows.select(people.infer_name(F.col("t")).alias("name"))
    assert [r["name"] for r in made.collect()] == [name] * (len(said) + 2) + ["Boy Jones", "", "", ""]
    monkeypatch.setattr(people, "_after_initial", lambda name: F.raise_error(F.concat(F.lit("searched"), name)).cast("string"))
    plain = spark.createDataFrame([("Letter about 1-URGENT\nJan 5, 2024\nProvider note of order 7",), ("",), (None,)], "t string")
    assert [r["name"] for r in plain.select(people.infer_name(F.col("t")).alias("name")).collect()] == [""] * 3
