"""Pull ranges: what an export covers, and the marks that move on from it."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.records import latest_day

MAX_AGE_MINUTES = 26 * 60


def recent_range(days: int = 3, start: str = "", end: str = "", everything: bool = False, today: str = "") -> tuple[str, str]:
    """The last days up to `end` or today; everything has no bounds."""
    if everything:
        return "", ""
    if days < 1:
        raise ValueError("days must be positive")
    last = end or today or date.today().isoformat()
    return start or (date.fromisoformat(last) - timedelta(days=days - 1)).isoformat(), last


def resolve_range(cards: DataFrame, today: str, days: int = 0, start: str = "", end: str = "", latest: bool = False, since: str | None = None, everything: bool = False) -> tuple[str, str]:
    """The range that one mode asks for: latest day, since a mark, everything, explicit or recent days. Two modes at once are an error."""
    modes = [bool(latest), since is not None, bool(everything), bool(start or end)]
    if sum(modes) > 1:
        raise ValueError("only one way to choose a range can be given")
    if latest or since is not None:
        last = latest_day(cards, today).first()["latest_day"]
        if not last:
            raise ValueError("no card has a clinical day up to today")
        return (last, last) if latest else since_last_pull(since, last, days or 3)
    return recent_range(days or 3, start, end, everything, today)


def since_last_pull(mark: str, last: str, days: int = 3, earlier_end: str = "") -> tuple[str, str]:
    """From the mark on (inclusive), else from the end of an earlier export, else the last days; not beyond the latest day."""
    start = mark or earlier_end or recent_range(days, end=last)[0]
    return min(start, last), last


def since_last_pull_all(cards: DataFrame, marks: DataFrame, today: str, days: int = 3) -> DataFrame:
    """Ranges of many scopes: `scope_key`, `start`, `end` from `cards` with a `scope_key`."""
    from sheaf.functions.dates import clinical_date_iso

    day = clinical_date_iso(F.col("date"))
    last = cards.select("scope_key", day.alias("day")).where((F.col("day") != "") & (F.col("day") <= today)).groupBy("scope_key").agg(F.max("day").alias("end"))
    own = last.join(marks.select("scope_key", "last_clinical_date"), "scope_key", "left")
    fallback = F.date_format(F.date_sub(F.try_to_date("end", "yyyy-MM-dd"), days - 1), "yyyy-MM-dd")
    start = F.coalesce(F.nullif("last_clinical_date", F.lit("")), fallback)
    return own.select("scope_key", F.least(start, F.col("end")).alias("start"), "end")


def advance_mark(scope: str, last: str, count: int, freshness: str) -> tuple[bool, str]:
    """Whether the mark moves, and if not why."""
    if freshness != "safe":
        return False, f"freshness_{freshness}"
    if not count or not last:
        return False, "nothing_exported"
    return True, ""


def advance_marks(pulls: DataFrame) -> DataFrame:
    """For many scopes (`scope_key`, `last`, `count`, `freshness`): whether the mark moves, and if not why."""
    reason = F.when(F.col("freshness") != "safe", F.concat(F.lit("freshness_"), "freshness")).when((F.col("count") == 0) | (F.col("last") == ""), "nothing_exported").otherwise("")
    return pulls.select("scope_key", (reason == "").alias("moves"), reason.alias("reason"))


def assert_fresh(stamp: str | None, now: datetime, minutes: int = MAX_AGE_MINUTES) -> None:
    """An error unless the last complete run is recent."""
    if not stamp:
        raise ValueError("no complete run is known")
    try:
        then = datetime.fromisoformat(stamp.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"no time: {stamp}") from e
    if now - then > timedelta(minutes=minutes):
        raise ValueError("the last complete run is too old")
