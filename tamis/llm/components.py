"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _is_stars(e: DataFrame) -> bool:
    """Whether every node but the roots has one link, to a root (links go from the larger to the smaller)."""
    n = e.agg(F.count("*"), F.count_distinct("a")).first()
    return n[0] == n[1] and not e.join(e.select(F.col("b").alias("a")), "a", "left_semi").take(1)


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable. links(a, b) of one integer type.

    Rounds grow with the logarithm of the longest chain; `most` is a guard that raises instead of going on for ever.
    """
    e = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most):
        if _is_stars(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = stage(_small_star(stage(_large_star(e), "links")), "links")
    raise RuntimeError("components did not settle")
