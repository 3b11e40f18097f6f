"""Counts and summaries. All are aggregates with map-side parts; reports of the largest keys are top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import clinical
from sheaf.functions.dates import clinical_date_iso
from sheaf.functions.text import first_nonempty, or_empty
from sheaf.functions.urls import source_host


def count_by(rows: DataFrame, key: Column) -> DataFrame:
    """Rows by key; empty keys do not count."""
    return rows.select(key.alias("key")).where("key is not null and key <> ''").groupBy("key").agg(F.count("*").alias("n"))


def host_counts(rows: DataFrame, url: str = "source_url") -> DataFrame:
    return count_by(rows, source_host(F.col(url)))


def top_counts(rows: DataFrame, key: Column, n: int = 12) -> DataFrame:
    """The n largest counts, ties by key. The limit is the feature."""
    return count_by(rows, key).orderBy(F.desc("n"), "key").limit(n)


#: Repeated keys that a report lists. Fixed value.
LISTED = 25


def duplicate_counts(rows: DataFrame, key: Column, listed: int = LISTED) -> DataFrame:
    """One row: keys that occur more than once, the rows beyond their first, and the most frequent of them (`top_keys`: array of key and n)."""
    many = count_by(rows, key).where("n > 1")
    # At most `listed` rows in one.
    head = many.orderBy(F.desc("n"), "key").limit(listed)
    top = head.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["key"].alias("key"), (-x["m"]).alias("n"))).alias("top_keys"))
    return many.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")).crossJoin(top)


def inspect_key() -> Column:
    """The key by which an export is inspected: raw URL, analyte or title, and day, without patient."""
    return F.concat_ws("|", or_empty("source_url"), or_empty("title"), clinical_date_iso(F.col("date")))


def _delta(start: str, end: str, everything: bool) -> list[Column]:
    """Aggregates over `day` ('' for undated rows, which do not count)."""
    day, dated = F.col("day"), F.col("day") != ""
    repeated = start if start and end and start < end else ""
    late = (day < start) if start else F.lit(False)
    again = ~late & ((day == repeated) if repeated else F.lit(False))
    new = ~late & ~again & ((day > start) if start else F.lit(True))
    return [
        F.lit("all" if everything else "date-range" if start and end else "unknown").alias("mode"),
        F.count_if(dated & new).alias("new_records"),
        F.lit(0).cast("long").alias("updated_records"),
        F.count_if(dated & again).alias("repeated_records"),
        F.count_if(dated & late).alias("late_records"),
        F.lit(repeated).alias("repeated_date"),
        F.coalesce(F.max(F.when(dated, day)), F.lit("")).alias("latest_date"),
    ]


def clinical_delta(rows: DataFrame, start: str = "", end: str = "", everything: bool = False) -> DataFrame:
    """One row of what is new since `start`: undated rows do not count; a range of one day counts no row of it."""
    return rows.select(clinical_date_iso(F.col("date")).alias("day")).agg(*_delta(start, end, everything))


def saved_quality(records: DataFrame, vocabulary: clinical.Vocabulary = clinical.DEFAULT) -> DataFrame:
    """One row: visits, notes among them, with and without substance, and counts by type."""
    visit = F.col("category") == "visits"
    note = clinical.is_visit_note(F.col("category"), F.col("record_type"), F.col("source_url"))
    substance = clinical.has_substance(F.concat_ws("\n", or_empty("title"), or_empty("summary"), or_empty("raw_text")), vocabulary)
    kinds = records.groupBy(first_nonempty("record_type", F.lit("unknown")).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(visit).alias("visits"), F.count_if(note).alias("notes"), F.count_if(note & substance).alias("substantive")
    )
    # One row a record type from here on.
    return kinds.agg(
        F.coalesce(F.sum("visits"), F.lit(0)).alias("visit_records"),
        F.coalesce(F.sum("notes"), F.lit(0)).alias("visit_notes"),
        F.coalesce(F.sum("substantive"), F.lit(0)).alias("substantive_notes"),
        F.coalesce(F.sum(F.col("notes") - F.col("substantive")), F.lit(0)).alias("shell_like_notes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("record_types"),
    )


def date_range(rows: DataFrame) -> DataFrame:
    day = F.nullif(clinical_date_iso(F.col("date")), F.lit(""))
    return rows.agg(F.coalesce(F.min(day), F.lit("")).alias("start_date"), F.coalesce(F.max(day), F.lit("")).alias("end_date"))


def patient_options(cards: DataFrame) -> DataFrame:
    """Patients by key with the label seen last."""
    return cards.where("patient.key is not null and patient.key <> ''").groupBy(F.col("patient.key").alias("key")).agg(F.max_by("patient.label", "seq").alias("label")).orderBy("label", "key")


def category_options(cards: DataFrame) -> DataFrame:
    return cards.select("category").where("category is not null and category <> ''").distinct().orderBy("category")


def redacted(text: Column) -> Column:
    """A status text without addresses."""
    return F.regexp_replace(or_empty(text), r"(?i)\b[a-z][a-z0-9+.-]*://\S+", "[url]")


def safe_summary(cards: DataFrame, status: str = "", **filters: str) -> DataFrame:
    """One row without names, titles, text or hosts: number of records and hosts, latest day, categories by count, which filters were set (`has_...`), the status without addresses."""
    by = cards.groupBy(first_nonempty("category", F.lit("record")).alias("category"), source_host(F.col("source_url")).alias("host")).agg(F.count("*").alias("n"), F.max(clinical_date_iso(F.col("date"))).alias("day"))
    per = by.groupBy("category").agg(F.sum("n").alias("n"), F.max("day").alias("day"))
    hosts = by.where("host <> ''").agg(F.count_distinct("host").alias("host_count"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category"))), lambda x: F.concat(x["category"], F.lit(":"), (-x["m"]).cast("string")))
    made = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.max("day"), F.lit("")).alias("latest_date"), F.array_join(listed, ",").alias("categories")).crossJoin(hosts)
    if status:
        made = made.withColumn("status", redacted(F.lit(status)))
    return made.withColumns({f"has_{name}": F.lit(bool(value)) for name, value in filters.items()})


def run_summary(pages: DataFrame) -> DataFrame:
    """From page results (`run`, `category`, `failed`, `records`, `truncated`): per run and category its counts and completion, and whether the run is safe to go on from."""
    per = pages.groupBy("run", "category").agg(F.count("*").alias("pages"), F.sum("records").alias("records"), F.count_if("failed").alias("errors"), F.bool_or("truncated").alias("truncated"))
    state = F.when(F.col("errors") > 0, "required_error").when(F.col("truncated"), "truncated").when(F.col("records") == 0, "suspicious").otherwise("completed")
    per = per.withColumn("completion", state)
    runs = per.groupBy("run").agg(F.bool_and(F.col("completion") == "completed").alias("freshness_safe"))
    return per.join(runs, "run")


#: What changes a page's records make in a store.
CHANGES = ("inserted", "updated", "unchanged", "deleted")


def run_report(pages: DataFrame) -> DataFrame:
    """One row a run from page results (those of `run_summary`, `stage` of a failure, `malformed`, `route_class`, `visited`, and the counts of `CHANGES`): sums, errors by stage, routes found and visited, completion by category, why the run ended, and whether it is safe to go on from.

    Routes that were found and not visited are pending. Groups are a few words a run,
    so the maps are small whatever the number of pages.
    """
    visited = F.coalesce("visited", F.lit(True))
    groups = pages.groupBy("run", "category", F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("route_class", F.lit("")).alias("route")).agg(
        F.count("*").alias("found"),
        F.count_if(visited).alias("visited"),
        F.count_if("failed").alias("errors"),
        F.sum("records").alias("records"),
        F.bool_or("truncated").alias("truncated"),
        F.bool_or("malformed").alias("malformed"),
        *(F.sum(c).alias(c) for c in CHANGES),
    )

    def said(by: str, *counts: str) -> DataFrame:
        each = groups.groupBy("run", by).agg(*(F.sum(c).alias(c) for c in counts)).where(F.col(counts[0]) > 0)
        text = F.concat(F.col(by), F.lit("="), F.concat_ws("/", *(F.col(c).cast("string") for c in counts)))
        return each.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias(f"by_{by}"))

    per = groups.groupBy("run", "category").agg(F.sum("errors").alias("errors"), F.bool_or("truncated").alias("truncated"), F.bool_or("malformed").alias("malformed"), F.sum(F.col("found") - F.col("visited")).alias("pending"))
    per = per.withColumn("completion", F.when(F.col("malformed"), "malformed").when(F.col("errors") > 0, "required_error").otherwise("completed"))
    completion = per.groupBy("run").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit("="), "completion"))), ",").alias("by_category"),
        F.when(F.bool_or("truncated"), "truncated").otherwise("queue_exhausted").alias("reason"),
        (~F.bool_or("truncated") & (F.sum("pending") == 0) & F.bool_and(F.col("completion") == "completed")).alias("freshness_safe"),
    )
    totals = groups.groupBy("run").agg(F.sum("visited").alias("pages"), F.sum("records").alias("records"), F.sum("errors").alias("errors"), *(F.sum(c).alias(c) for c in CHANGES))
    out = totals.join(completion, "run").join(said("stage", "errors"), "run", "left").join(said("route", "found", "visited"), "run", "left")
    return out.withColumns({"by_stage": or_empty("by_stage"), "by_route": or_empty("by_route")})


def manifest(records: DataFrame, chunks: DataFrame | None = None, filters: str = "", start: str = "", end: str = "") -> DataFrame:
    """One row about an export: schema version, counts, text bytes, what is new. Chunks are counted by the records' `chunk_count`, or from their own rows."""
    day = F.col("date_iso") if "date_iso" in records.columns else clinical_date_iso(F.col("date"))
    own = F.col("chunk_count") if chunks is None else F.lit(0)
    rows = records.select(day.alias("day"), F.col("text_bytes").alias("b"), F.lit(1).alias("r"), own.cast("long").alias("c"))
    if chunks is not None:
        rows = rows.unionAll(chunks.select(F.lit(""), F.lit(0).cast("long"), F.lit(0), F.lit(1).cast("long")))
    total = lambda name, to: F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(to)
    made = rows.agg(total("r", "record_count"), total("c", "chunk_count"), total("b", "text_bytes"), *_delta(start, end, not start and not end))
    return made.select(F.lit(1).alias("schema_version"), F.lit(filters).alias("filters"), "*")
