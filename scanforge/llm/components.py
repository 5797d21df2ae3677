"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation with map-side partial sums and one equi-join, so a node with very many
neighbours is a skewed join key that adaptive execution splits, and never a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        moved = edges.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").groupBy("a", "b").agg(F.lit(1).alias("n")).select("a", "b")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): for every node that has an edge, the smallest node it can reach.

    Nulls and self-loops carry no link and are left out. Nodes need a total order (numbers, strings).
    An empty table gives an empty table. The work stops when a round changes nothing.
    """
    x, y = F.col(a), F.col(b)
    now = cut(
        edges.where(x != y)
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .groupBy("a", "b").agg(F.lit(1).alias("n")).select("a", "b")
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        now = cut(_star(_star(now, large=True), large=False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
