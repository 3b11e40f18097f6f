"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that contain it,
k / n, exceeds a ratio, and more than one page does: what only one page has is no
boilerplate, however few pages the host has. Everything runs in built-in functions:
each page sends the digests of its different lines (never the lines) through one
shuffle with map-side counts; what exceeds the ratio is at most (mean lines of a
page) / ratio digests for a host, kept as one small row per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise

#: A line on more than this share of a host's pages is boilerplate.
MAX_RATIO = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, copies: bool = True) -> DataFrame:
    """Per host with boilerplate: `host`, `digests` (array of the lines' MD5), and its `pages`.

    A page counts a line once, however often it repeats it. Blank lines never count.
    Without `copies`, pages of a host with equal texts count as one page.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where("host is not null and text is not null")
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), F.md5))
    pages = pages.select("host", "text", digests.alias("digests"))
    if not copies:
        # Copies meet in the map-side aggregate; only digests are shuffled.
        pages = pages.groupBy("host", F.sha2("text", 256).alias("page")).agg(F.first("digests").alias("digests"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    holding = pages.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("k")).where("k > 1")
    over = holding.join(totals, "host").where(F.col("k") / F.col("pages") > max_ratio)
    return over.groupBy("host").agg(F.collect_list("digest").alias("digests"), F.first("pages").alias("pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, dropped: str | None = None, copies: bool = True) -> DataFrame:
    """The same rows and columns, their texts without the boilerplate lines of their host.

    Null texts stay null and rows without a host keep their text: there is no site
    to compare with. A text that is boilerplate throughout becomes ''. Repeated rows
    count as pages of their own with `copies`; without, a text that a host holds many
    times is one page and no boilerplate of its own. An empty table stays empty. With `dropped`, a column
    of that name counts the lines that went, in the place of any that `docs` has.
    Hosts with many pages are looked up by broadcast; only pages of small ones are
    shuffled, once there are more of these than a broadcast takes.
    """
    columns = [c for c in docs.columns if c != dropped]
    bad = materialise(boilerplate(docs, host, text, max_ratio, copies), "boilerplate").select(F.col("host").alias("__ld_host"), F.col("digests").alias("__ld_digests"), F.col("pages").alias("__ld_pages"))
    joined = looked_up(docs.withColumn("__ld_host", F.col(host)), bad, ["__ld_host"], n="__ld_pages", how="left")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col("__ld_digests"), F.md5(x)))
    none = F.col("__ld_digests").isNull()
    out = joined.withColumn("__ld_kept", F.when(none, F.lit(None)).otherwise(kept))
    if dropped is not None:
        out = out.withColumn(dropped, F.when(F.col("__ld_kept").isNull(), 0).otherwise(F.size(_lines(F.col(text))) - F.size("__ld_kept")).cast("long"))
    out = out.withColumn(text, F.when(F.col("__ld_kept").isNull(), F.col(text)).otherwise(F.array_join("__ld_kept", "\n")))
    return out.select(*columns, *([dropped] if dropped is not None else []))
