"""Mixing sources to target weights that change over training.

Each source has a weight schedule, linear between knots of the training time 0 to 1.
Its integral is the source's weight in the whole mix; its running integral says how
much of the source's demand is met by a time, and the inverse of that gives each
document its training position: the time at which the source's running demand reaches
the words before it. Documents are sorted by position in range partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise
from sheaf.operators.records import number_globally, running_totals

#: A schedule: (time, weight), from time 0 to time 1, weights not negative.
Schedule = Sequence[tuple[float, float]]

#: Sources in order of their names take these in turn: heavy at first and then less, even, and light at first and then more. Their integrals are 5, 2 and 1.
SCHEDULES: list[Schedule] = [[(0.0, 6.0), (0.5, 6.0), (1.0, 2.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (0.5, 0.5), (1.0, 2.5)]]

#: A source is repeated this often at most.
REPEATS = 3

#: What separates words.
WORD = r"[^\x20\x09-\x0D]++"


def integral(schedule: Schedule) -> Fraction:
    """The area below a schedule, exact."""
    own = [(Fraction(t), Fraction(w)) for t, w in schedule]
    if not own or own[0][0] != 0 or own[-1][0] != 1 or any(w < 0 for _, w in own) or any(b[0] <= a[0] for a, b in zip(own, own[1:], strict=False)):
        raise ValueError("a schedule runs from time 0 to time 1 with weights that are not negative")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(own, own[1:], strict=False))
    if not area:
        raise ValueError("a schedule has no weight")
    return Fraction(area)


def whole_weights(schedules: Sequence[Schedule]) -> list[int]:
    """The integrals of schedules as whole numbers of the same ratios."""
    areas = [integral(s) for s in schedules]
    scale = math.lcm(*(a.denominator for a in areas))
    whole = [int(a * scale) for a in areas]
    common = math.gcd(*whole)
    return [w // common for w in whole]


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which a source with this schedule has met a share (0 to 1) of its demand.

    The running integral is a square function between two knots: with `a` the weight
    at the first and `s` its slope, an area `r` past the knot is reached after
    2 r / (a + sqrt(a^2 + 2 s r)), which also holds without a slope.
    """
    met, at = 0.0, None
    need = share * float(integral(schedule))
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        rest, slope = need - met, (b - a) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        here = F.lit(t0) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(a) + root)).otherwise(0.0)
        at = here if at is None else F.when(need >= met, here).otherwise(at)
        met += (t1 - t0) * (a + b) / 2
    return at


def _targets(sources: DataFrame, total: int) -> DataFrame:
    """`sources` (`weight`, `source_size`) with `target`: shares of `total` by weight, those above `REPEATS` times their source cut to that and the excess shared again.

    The sources above are found by aggregates over the table of sources, one a round;
    a round can only add to them.
    """
    cap = F.col("source_size") * REPEATS
    wide = lambda c: c.cast("decimal(19,0)")
    num, den, capped = total, sources.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        above = wide(F.col("weight")) * F.lit(num).cast("decimal(19,0)") > wide(cap) * F.lit(den).cast("decimal(19,0)")
        got = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        if got[2] == capped:
            break
        num, den, capped = total - got[0], got[1], got[2]
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise((F.col("weight") * F.lit(num).cast("long")).cast("double") / F.lit(float(den))))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", schedules: Sequence[Schedule] = SCHEDULES, seed: int = 0) -> DataFrame:
    """The training mix: one row for each copy of a document, sorted by `position` in range partitions.

    Columns: `row` (one number for each row of `docs`), `id`, `source`, `size` (words),
    `source_size`, `target` (words that the mix should take of the source), `epoch`
    (from 0), `words` (what this copy gives), `position` (0 to 1) and `offset` (words of
    the mix before this copy). A source's words are taken in an order that only ids and
    `seed` decide, again from the first when they are used up; the copy that reaches
    the target gives its first words only, so a source gives its target, rounded.

    Sources take `schedules` in turn, by code point with null last. All sizes are
    shared by the schedules' integrals, at most `REPEATS` times a source's size. A
    document of which nothing is taken (also a null or empty text) has one row with no
    words; rows that repeat count each; other columns of `docs` are not read; of an
    empty table nothing is taken. Only sizes, ids and sources are shuffled: running
    sums go over range partitions, so a source with most rows is many tasks.
    """
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))), 1, 16)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    thin = materialise(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    weights = whole_weights(schedules)
    own = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    known = number_globally(own, [F.col("source").isNull(), F.col("source")])
    kind = ((F.col("number") - 1) % len(schedules)).cast("int")
    known = materialise(known.select(F.col("number").alias("no"), "source", "source_size", "n", kind.alias("kind"), F.element_at(F.array(*map(F.lit, weights)), kind + 1).cast("long").alias("weight")), "sources")
    sums = known.agg(F.sum("source_size"), F.sum("n")).first()
    if not sums[1]:
        return thin.select(F.lit(0).cast("long").alias("row"), "id", "source", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("epoch"), F.col("size").alias("words"), F.lit(0.0).alias("position"), F.col("size").alias("offset"))
    aimed = _targets(known, sums[0]).select("no", F.col("source").alias("__source"), "source_size", "n", "kind", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))
    # A null source is looked up like any other.
    named = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))
    rows = looked_up(thin.withColumn("__by", named(F.col("source"))), aimed.withColumn("__by", named(F.col("__source"))).drop("__source"), ["__by"], total=sums[1]).drop("__by")
    placed = running_totals(rows, ["key", "id", "size"], "size", "before", scope="no").withColumn("row", F.monotonically_increasing_id())
    # Numbers of rows have to stay the same for all copies: they are read from a stored table.
    placed = materialise(placed, "placed")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    words = F.greatest(F.least(F.col("size"), F.col("quota") - start), F.lit(0))
    copies = placed.withColumn("epoch", epochs).withColumn("start", start).withColumn("words", words).where("epoch = 0 or words > 0")
    share = F.when(F.col("quota") > 0, F.col("start").cast("double") / F.col("quota").cast("double")).otherwise(0.0)
    at = F.lit(0.0)
    for k, schedule in enumerate(schedules):
        at = F.when(F.col("kind") == k, time_of(share, schedule)).otherwise(at)
    timed = copies.withColumn("position", at).select("row", "id", "source", "size", "source_size", "target", "epoch", "words", "position", "no", "start")
    order = ["position", "no", "start"]
    return running_totals(timed, order, "words", "offset").repartitionByRange(*order).sortWithinPartitions(*order).drop("no", "start")


def per_document(mixed: DataFrame) -> DataFrame:
    """One row for each document of a mix: `id`, `source`, `size`, `source_size`, `target`, `taken` words, `first_offset` (null if nothing is taken)."""
    same = [F.first(c).alias(c) for c in ("id", "source", "size", "source_size", "target")]
    return mixed.groupBy("row").agg(*same, F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("offset"))).alias("first_offset")).drop("row")
