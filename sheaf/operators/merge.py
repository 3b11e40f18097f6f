"""Merging new pages into a record store: replacing a source's rows, upserts, cards, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import clinical
from sheaf.functions.dates import group_date
from sheaf.functions.text import first_nonempty, or_empty
from sheaf.functions.urls import is_past_visit_detail, source_url_key, visit_key
from sheaf.operators.records import index_card
from sheaf.sources.shared import looked_up, materialise


def _shell() -> Column:
    text = F.concat_ws("\n", or_empty("title"), or_empty("summary"), or_empty("raw_text"))
    return clinical.is_invalid_shell(F.col("category"), F.col("record_type"), F.col("title"), text, F.col("source_url"))


def without_shells(records: DataFrame) -> DataFrame:
    """Records but for pages' empty frames."""
    return records.where(~_shell())


def row_key(rows: DataFrame) -> list[str]:
    """What names a row: the id, with `content_key` (never null) where rows have one, as made ids end in a hash of 32 bits."""
    return ["id", "content_key"] if "content_key" in rows.columns else ["id"]


def orphan_cards(cards: DataFrame, records: DataFrame, incoming: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Cards whose record is gone once `deleted` went and `incoming` came."""
    left = records.select("id")
    if deleted is not None:
        left = left.join(deleted.select("id"), "id", "left_anti")
    if incoming is not None:
        left = left.unionByName(incoming.select("id"))
    return cards.where("id is not null and id <> ''").join(left, "id", "left_anti")


def records_without_cards(records: DataFrame, cards: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Records that lack a card, without deleted ones and shells."""
    out = records.where("id is not null and id <> ''").join(cards.select("id"), "id", "left_anti")
    if deleted is not None:
        out = out.join(deleted.select("id"), "id", "left_anti")
    return out.where(~_shell()) if {"raw_text", "category"} <= set(out.columns) else out


def ids_to_replace(existing: DataFrame, incoming: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Ids (see `row_key`) of existing rows whose source was read again (`source_url` of `sources`, else of `incoming`) and that it no longer gives.

    A visit's past details also go when another page of the visit came. A source
    that gives no row at all deletes its rows. Empty sources match nothing, so they
    make no hot key.
    """
    names = row_key(existing)
    return _read_again(existing, sources if sources is not None else incoming).join(incoming.select(*names), names, "left_anti")


def _read_again(existing: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids of existing rows that a reading of `sources` replaces, whatever it gives."""
    names = row_key(existing)
    read = sources.select("source_url").distinct()
    keyed = existing.where("id is not null and id <> ''").select(*names, source_url_key(F.col("source_url")).alias("key"), visit_key(F.col("source_url")).alias("visit"), is_past_visit_detail(F.col("source_url")).alias("past"))
    urls = read.select(source_url_key(F.col("source_url")).alias("key")).where("key <> ''").distinct()
    visits = read.select(visit_key(F.col("source_url")).alias("visit")).where("visit <> ''").distinct()
    same = keyed.where("key <> ''").join(urls, "key", "left_semi").select(*names)
    past = keyed.where("past and visit <> ''").join(visits, "visit", "left_semi").select(*names)
    return same.unionByName(past).distinct()


def upsert(existing: DataFrame, incoming: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The store after a batch with `delta` for each row: inserted, updated, unchanged, deleted, untouched.

    `incoming` has one row a key (see `row_key` and `latest_in_batch`). Rows are compared by all
    columns, null-safe. Deleted rows are kept as such; the store is what is not deleted.
    """
    columns, names = existing.columns, row_key(existing)
    # What `incoming` gives again is told from what is gone by its row.
    gone = _read_again(existing, sources if sources is not None else incoming).select(*names, F.lit(True).alias("gone"))
    old = existing.join(gone, names, "left").select(*names, F.struct(*columns).alias("old"), F.coalesce("gone", F.lit(False)).alias("gone"))
    new = incoming.select(*names, F.struct(*columns).alias("new"))
    both = old.join(new, names, "full_outer")
    delta = (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNotNull(), F.when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated"))
        .when(F.col("gone"), "deleted")
        .otherwise("untouched")
    )
    return both.select(F.coalesce("new", "old").alias("row"), delta.alias("delta")).select("row.*", "delta")


def latest_in_batch(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Of a batch, each source's last reading, and of a key (see `row_key`) its last row.

    Rows without a source or `seq` belong to no reading and all pass the first rule.
    """
    url = source_url_key(F.col("source_url"))
    keyed = rows.withColumn("__read", F.coalesce((url != "") & F.col(seq).isNotNull(), F.lit(False)))
    # Rows of no reading are spread by their id.
    keyed = keyed.withColumn("__key", F.when(F.col("__read"), url).otherwise(F.concat(F.lit("\0"), or_empty("id"))))
    # A source with most rows is looked up like a small one.
    last = materialise(keyed.where("__read").groupBy("__key").agg(F.max(seq).alias("__last"), F.count("*").alias("n")), "last")
    alone = keyed.where("not __read").withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType))
    kept = looked_up(keyed.where("__read"), last, ["__key"]).where(F.col(seq) == F.col("__last")).unionByName(alone)
    return kept.groupBy(*row_key(rows)).agg(F.max_by(F.struct(*rows.columns), F.struct(seq)).alias("r")).select("r.*")


def repaired_cards(records: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards of records, those kept that have one, others made anew."""
    kept = cards.join(records.select("id"), "id", "left_semi")
    return kept.unionByName(index_card(records_without_cards(records, cards)).select(*cards.columns))


def cleanup(records: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without shells and orphan cards, and with the cards that were missing."""
    kept = records.where(~_shell())
    return kept, repaired_cards(kept, cards)


def with_cards(records: DataFrame, cards: DataFrame) -> DataFrame:
    """Records as their cards tell them (J9 with J1): without shells, and with what a card of theirs says of title, type, category, date and source before what the record does. Cards of no record count for nothing, a record without one speaks for itself; of several cards of an id the least counts."""
    said = ["title", "record_type", "category", "date", "source_url"]
    own = cards.groupBy("id").agg(F.min(F.struct(*(or_empty(c).alias(c) for c in said))).alias("__card"))
    joined = without_shells(records).join(own, "id", "left")
    return joined.withColumns({c: first_nonempty(F.col(f"__card.{c}"), F.col(c)) for c in said}).drop("__card").select(*records.columns)


def title_key(title: Column) -> Column:
    """For comparing titles: letters and digits, without brackets and case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(or_empty(title)), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))


#: Lengths of the substrings by which titles are found; a title is asked for by its longest.
GRAMS = (1, 2, 4, 8, 16, 32)


def _grams(title: Column, length: Column) -> Column:
    """The distinct substrings of one length; none of a shorter title."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(title) - length + 1, F.lit(1)))
    return F.when(F.length(title) >= length, F.array_distinct(F.transform(starts, lambda i: F.substr(title, i, length)))).otherwise(F.array())


def contained(small: DataFrame, large: DataFrame, by: Sequence[str], title: str) -> DataFrame:
    """Pairs of a title of `small` that stands in one of `large` with the same `by`: `by`, `small`, `large`. Both hold distinct, not empty titles.

    What stands in a title has all its substrings there. Each title of `large` gives its
    substrings of the lengths `GRAMS`, each of `small` asks for one: of its longest
    length the one that the fewest titles of `large` have. So titles meet by an equal
    substring, not all of a group with all; a title with a substring that none has
    falls out at once. Substrings compress so well that their files say nothing of
    their number, so these joins are never broadcasts.
    """
    longest = F.array_max(F.filter(F.array(*map(F.lit, GRAMS)), lambda n: n <= F.length(title)))
    asks = materialise(small.select(*by, F.col(title).alias("small"), longest.alias("__n")), "asks")
    asked_lengths = asks.select(*by, "__n").distinct()
    every = F.array(*(F.struct(F.lit(n).alias("n"), _grams(F.col(title), F.lit(n)).alias("gs")) for n in GRAMS))
    each = large.select(*by, F.col(title).alias("large"), F.explode(every).alias("e")).select(*by, "large", F.col("e.n").alias("__n"), F.col("e.gs").alias("__gs"))
    # Only lengths that a title of the group asks for are spread out.
    each = each.where(F.size("__gs") > 0).join(asked_lengths, [*by, "__n"], "left_semi").select(*by, "large", "__n", F.explode("__gs").alias("__g"))
    stored = materialise(each, "grams")
    having = stored.groupBy(*by, "__n", "__g").agg(F.count("*").alias("__have"))
    own = asks.select("*", F.explode(_grams(F.col("small"), F.col("__n"))).alias("__g")).join(having.hint("merge"), [*by, "__n", "__g"], "left")
    # One of its substrings that nobody has settles a title.
    best = own.groupBy(*by, "small", "__n").agg(F.min(F.struct(F.coalesce("__have", F.lit(0)).alias("have"), F.col("__g").alias("g"))).alias("b")).where("b.have > 0")
    met = best.select(*by, "small", "__n", F.col("b.g").alias("__g")).join(stored.hint("merge"), [*by, "__n", "__g"])
    return met.where(F.contains("large", "small")).select(*by, "small", "large")


def unmatched_derived(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Derived rows without a stored lab of the same patient and day whose title equals, contains or is contained in theirs.

    Titles of a patient's day are compared once each, by `contained` in both
    directions, so a day of very many titles is no product of them. Rows that lack a
    part of the key stay.
    """
    by = ["__who", "__day"]
    who = first_nonempty("patient.key", "patient.label")
    day = group_date(F.col("date"))["day_key"]
    whole = "__who <> '' and __day <> '' and __title <> ''"
    labs = stored.where("category = 'test-results'").select(who.alias("__who"), day.alias("__day"), title_key(F.col("title")).alias("__title")).where(whole).distinct()
    # Without labs nothing is matched, and what is derived need not be made to see that.
    labs = materialise(labs, "stored")
    if labs.isEmpty():
        return derived
    # Derived rows are made of texts that are read line by line: once, for the question and the answer.
    derived = materialise(derived, "derived")
    group = F.col("derived_from.group_title") if "derived_from" in derived.columns else F.lit("")
    own = derived.withColumns({"__who": who, "__day": day, "__title": title_key(first_nonempty(group, "title"))})
    asked = own.select(*by, "__title").where(whole).distinct()
    # Only titles of days that both sides have can meet.
    asked = materialise(asked.join(labs.select(*by).distinct(), by, "left_semi"), "asked")
    labs = materialise(labs.join(asked.select(*by).distinct(), by, "left_semi"), "labs")
    inner = contained(asked, labs, by, "__title").select(*by, F.col("small").alias("__title"))
    outer = contained(labs, asked, by, "__title").select(*by, F.col("large").alias("__title"))
    known = materialise(inner.union(outer).distinct(), "known")
    return own.join(known, [*by, "__title"], "left_anti").select(*derived.columns)
