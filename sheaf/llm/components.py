"""Connected components of a table of edges, by alternating stars, in shuffles of thin rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import looked_up, materialise


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Tie the neighbours of each node to the smallest one among them and itself: its larger neighbours (`large`), or the node and its smaller ones."""
    count = F.count("*").alias("n")
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), count).select("a", F.least("a", "m").alias("m"), "n")
        out = looked_up(both, least, ["a"], total=2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), count)
        joined = looked_up(edges, least, ["a"], total=total)
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (`a`, `b`, any order): `node`, `root` for every node with an edge; the root is the smallest node of its component.

    Each half round is written to the shared folder. Nodes with many neighbours are an
    aggregate with map-side minima, and looked up by broadcast.
    """
    own = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        own = materialise(own, "edges")
        state = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        half = materialise(_star(own, True, state[0]), "edges")
        own = _star(half, False, half.count())
    return own.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own.select(F.col("b"), F.col("b")).distinct())
