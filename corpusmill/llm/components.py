"""Connected components over links, by alternating large-star and small-star steps (Kiveris et al., 2014).

All steps are joins and partial aggregations on node keys; nothing is gathered per component, and only a row at most reaches the driver
in each round. Each round is cut by a reliable checkpoint; when all components are stars, no further round is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    j = down.join(least, "u")
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u. Edges lead to the lesser node, so the centres are then the smallest of their components."""
    n = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("met")).union(e.select("v", F.lit(0), F.lit(1)))
    return n.groupBy("x").agg(F.sum("up").alias("up"), F.max("met").alias("met")).where("up > 1 or up = 1 and met = 1").isEmpty()


def roots(links: DataFrame, most: int = 60) -> DataFrame:
    """u, root: every node that is linked and isn't itself the smallest of its component. links: u, v of one orderable type."""
    e = cut_lineage(links.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    for _ in range(most):
        e = cut_lineage(_small_star(_large_star(e)))
        if _stars(e):
            return e.select("u", F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most} rounds")
