"""The frontier as rounds: what a run visits, from its seeds on, until nothing is left or a budget ends it.

A round visits a level of targets, in order, and the links of its pages make the next
level: as a queue would, but for all targets of a level at once. Details go first;
what only may be clinical waits until no detail is left, or until a listing that should
have had some had none. Each round joins its targets with the pages and with what was
seen before, all in tables of the shared folder; the driver only holds a few counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import first_nonempty
from sheaf.functions.urls import normalize_detail_url, route_identity, source_url_key, visit_key
from sheaf.operators import frontier, pages
from sheaf.operators.frontier import Budgets, within_budgets
from sheaf.sources.shared import laid_out, materialise

TARGET = ["identity_hash", "category", "url", "fallback_url", "route_class", "strict", "broad", "refresh", "covered", "o1", "o2", "o3"]
DETAILS = ("result-detail", "visit-detail")
#: Tables of seen targets after which they are written as one.
PARTS = 8


@dataclass(frozen=True)
class Run:
    """What a run did.

    `visits`: `position`, `round`, `category`, `url`, `identity_hash`, `route_class`,
    `status` (visited, failed where no page is known, skipped, or the budget that stopped
    it), `records`. `links`: `route_class` and how many links of visited pages are of it.
    `reason`: queue_exhausted or the budget. `mode`: strict, or exhaustive once broad
    targets were followed; `malformed`: categories whose listing said nothing.
    """

    visits: DataFrame
    links: DataFrame
    reason: str
    mode: str
    rounds: int
    malformed: list[str]

    @property
    def truncated(self) -> bool:
        return self.reason != "queue_exhausted"

    def covered(self) -> DataFrame:
        """Identities of details that the run visited."""
        return self.visits.where(F.col("status") == "visited").where("detail").select("identity_hash").distinct()

    def visited(self) -> DataFrame:
        """Addresses that the run visited."""
        return self.visits.where(F.col("status") == "visited").select(source_url_key(F.col("url")).alias("url_key")).distinct()


class _Grown:
    """A set of keys that grows by tables, which are written as one from time to time."""

    def __init__(self, first: DataFrame) -> None:
        self.parts = [first]

    def add(self, more: DataFrame) -> None:
        self.parts.append(more)
        if len(self.parts) > PARTS:
            self.parts = [materialise(self.all(), "seen")]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def crawl_job(page_rows: DataFrame, seeds: DataFrame, coverage: DataFrame | None = None, visited: DataFrame | None = None, stored: DataFrame | None = None, budgets: Budgets = Budgets(), context: str = "", expected_origin: str = "", exhaustive: bool = False, force: bool = False) -> Run:
    """Visit what `seeds` (see `frontier.seeds`) lead to among `page_rows` (`page_id`, `url`, `html`; `records`, what a page gives, and `empty`, whether it says that it lists nothing, if known).

    `coverage` (`identity_hash`) and `visited` (`url_key`) are of earlier runs, `stored`
    the records that there are; `force` visits all the same. Of several pages with an
    address the last `page_id` counts; pages without one are never found. Two targets of
    one address in a level are judged by earlier runs, not by one another.
    """
    spark = page_rows.sparkSession
    given = lambda name, none: F.coalesce(F.col(name), F.lit(none)) if name in page_rows.columns else F.lit(none)
    said = page_rows.select("page_id", source_url_key(F.col("url")).alias("page_key"), given("records", 0).cast("long").alias("records"), given("empty", False).alias("empty")).where("page_key <> ''")
    each_page = said.groupBy("page_key").agg(F.max_by(F.struct("page_id", "records", "empty"), "page_id").alias("p"), F.count("*").alias("__n"))
    site = materialise(each_page.select("page_key", "p.*", "__n"), "site")
    known = site.agg(F.count("*").alias("n"), F.max("__n").alias("most")).first()
    # A page's links are a row, and rows are laid by page, so that a round's visits are dealt to them and not they to the visits.
    links = pages.page_links(page_rows.select("page_id", "url", "html").where(source_url_key(F.col("url")) != ""))
    if (known["most"] or 0) > 1:
        links = links.join(site.select("page_id"), "page_id", "left_semi")
    links = laid_out(links, "links", "page_id", known["n"])
    site = site.drop("__n")

    none = lambda schema: spark.createDataFrame([], schema)
    # Every round asks for what earlier runs did, so it is made once; what there is none of is not asked for.
    before = None if coverage is None or force else materialise(coverage.select("identity_hash").distinct(), "coverage")
    told = None if stored is None or context else materialise(frontier.detail_coverage(stored), "told")
    urls_seen = None if visited is None or force else materialise(visited.select(F.col("url_key").alias("page_key")).distinct(), "visited")
    flag = F.lit(True)

    def with_coverage(targets: DataFrame) -> DataFrame:
        """`covered`: details that an earlier run visited, or whose record is stored."""
        out, known_by = targets, [F.lit(False)]
        if before is not None:
            out, known_by = out.join(before.withColumn("__a", flag), "identity_hash", "left"), [F.col("__a"), *known_by]
        if told is not None:
            own = F.when(F.col("category") == "visits", first_nonempty(visit_key(F.col("url")), source_url_key(F.col("url")))).otherwise(source_url_key(F.col("url")))
            out, known_by = out.withColumn("coverage_key", own).join(told.withColumn("__b", flag), "coverage_key", "left"), [F.col("__b"), *known_by]
        return out.withColumn("covered", F.coalesce(*known_by)).drop("__a", "__b", "coverage_key")

    start = frontier.classified(seeds.withColumn("text", F.lit("")).drop("identity_hash"), context, expected_origin)
    detail = F.col("route.route_class").isin(*DETAILS) & ~F.col("refresh")
    switch = F.col("route.route_class") == "proxy-switch"
    start = start.withColumns({"strict": detail, "route_class": F.when(detail, F.col("route.route_class")).when(switch, "proxy-switch").otherwise("discovery"), "broad": F.lit(False)})
    start = start.withColumns({"o1": F.round(F.col("priority") * 1000).cast("long"), "o2": F.col("refresh").cast("int"), "o3": F.lit(0).cast("long")})
    level = materialise(with_coverage(start).select(*TARGET), "level")
    seen = _Grown(level.select("identity_hash"))

    mode, reason, done, rounds = "exhaustive" if exhaustive else "strict", "queue_exhausted", 0, 0
    spent, waiting, visits, counts, malformed = (0, 0, 0), [], [], [], set()
    while True:
        found = level.withColumn("page_key", source_url_key(F.col("url"))).join(site, "page_key", "left")
        seen_before = F.lit(False)
        if urls_seen is not None:
            found, seen_before = found.join(urls_seen.withColumn("__seen", flag), "page_key", "left"), F.coalesce("__seen", F.lit(False))
        either = F.col("strict") | F.col("broad")
        wanted = frontier.should_visit(F.lit(force), F.col("covered"), seen_before, either, F.col("refresh"))
        judged = found.withColumn("wanted", wanted).withColumns({"page": (F.col("wanted") & F.col("page_id").isNotNull()).cast("int"), "attempt": (F.col("wanted") & F.col("broad")).cast("int")})
        judged = judged.withColumn("gain", F.col("page") * F.coalesce("records", F.lit(0)))
        kept = within_budgets(judged.drop("__seen", "page_key"), ["o1", "o2", "o3", "url"], "page", "attempt", "gain", "broad", budgets, spent)
        status = F.when(F.col("stopped") != "", F.col("stopped")).when(~F.col("wanted"), "skipped").when(F.col("page") == 1, "visited").otherwise("failed")
        kept = materialise(kept.withColumns({"position": F.col("position") + done, "status": status, "round": F.lit(rounds), "detail": either}), "visits")
        visits.append(kept)
        rounds += 1
        live = F.col("stopped") == ""
        total = kept.agg(F.count("*"), *(F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0)) for c in ("page", "attempt", "gain")), F.max("stopped"), F.coalesce(F.max(F.col("refresh") & (F.col("status") == "visited")), F.lit(False))).first()
        done, spent = done + total[0], tuple(a + b for a, b in zip(spent, total[1:4], strict=True))
        if total[4]:
            reason = total[4]
            break

        opened = kept.where("status = 'visited'")
        asked = opened.select("page_id", F.col("position").alias("parent"), F.col("category").alias("__category"))
        each = links.join(asked, "page_id").select("parent", "__category", F.posexplode("links").alias("pos", "l"))
        each = each.select("parent", "pos", "l.text", normalize_detail_url(F.col("l.href"), F.col("__category")).alias("url"), F.col("__category").alias("category"))
        each = materialise(frontier.classified(each, context, expected_origin).select("parent", "pos", "url", "category", "identity_hash", "route"), "classified")
        counts.append(each.groupBy("route.route_class").agg(F.count("*").alias("n")))
        fit = each.where("route.admission <> 'rejected'")
        if context:
            fit = fit.where("route.route_class <> 'proxy-switch'")
        fit = fit.withColumns({"rank": (~F.col("route.route_class").isin(*DETAILS)).cast("int"), "strict": F.col("route.admission") == "strict"})
        once = fit.groupBy("identity_hash").agg(F.min_by(F.struct("url", "category", F.col("route.route_class").alias("route_class"), "strict", F.col("parent").alias("o1"), F.col("rank").alias("o2"), F.col("pos").cast("long").alias("o3")), F.struct("parent", "rank", "pos")).alias("t"))
        fresh = once.select("identity_hash", "t.*").join(seen.all(), "identity_hash", "left_anti")
        fresh = fresh.withColumns({"broad": ~F.col("strict"), "refresh": F.lit(False), "fallback_url": F.lit("")})

        # A listing without links, records or a word that it is empty: its other address is tried, and what may be clinical waits no longer.
        early = None
        if total[5]:
            silent = opened.where("refresh and gain = 0 and not empty").join(fit.select(F.col("parent").alias("position")).distinct(), "position", "left_anti")
            silent = materialise(silent.select("position", "category", "fallback_url"), "silent")
            # Listings are seeds and their other addresses, so their categories are few.
            malformed = (malformed - {r[0] for r in opened.where("refresh").select("category").distinct().collect()}) | {r[0] for r in silent.select("category").distinct().collect()}
            early = silent.agg(F.min("position")).first()[0]
            again = silent.where("fallback_url <> ''").select("category", F.col("fallback_url").alias("url"), F.col("position").alias("o1"))
            again = again.withColumn("identity_hash", F.sha2(route_identity(F.col("url"), F.col("category"), F.lit(context)), 256))
            again = again.dropDuplicates(["identity_hash"]).join(seen.all(), "identity_hash", "left_anti").join(fresh.select("identity_hash"), "identity_hash", "left_anti")
            fresh = fresh.unionByName(again.withColumns({"route_class": F.lit("discovery-fallback"), "strict": F.lit(False), "broad": F.lit(True), "refresh": F.lit(True), "fallback_url": F.lit(""), "o2": F.lit(2), "o3": F.lit(0).cast("long")}))

        new = materialise(with_coverage(fresh).select(*TARGET), "found")
        seen.add(new.select("identity_hash"))
        at_once = F.col("strict") | F.col("refresh") | F.lit(mode == "exhaustive") | (F.col("o1") > (early if early is not None else 1 << 62))
        if early is not None:
            mode = "exhaustive"
        level, later = new.where(at_once), new.where(~at_once)
        waiting.append(later)
        if level.isEmpty():
            level = waiting[0]
            for part in waiting[1:]:
                level = level.unionByName(part)
            waiting = []
            if level.isEmpty():
                break
            mode, level = "exhaustive", materialise(level, "level")
    out, of_class = visits[0], counts[0] if counts else none("route_class string, n long")
    for part in visits[1:]:
        out = out.unionByName(part)
    for part in counts[1:]:
        of_class = of_class.unionByName(part)
    told_visits = out.select("position", "round", "category", "url", "identity_hash", "route_class", "detail", "status", F.when(F.col("status") == "visited", F.col("gain")).otherwise(0).alias("records"))
    return Run(told_visits, of_class.groupBy("route_class").agg(F.sum("n").alias("n")), reason, mode, rounds, sorted(malformed))
