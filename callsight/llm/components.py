"""Connected components of links, by alternating large-star and small-star steps.

Every step is a grouped minimum, written, and joined back to the links: the minimum combines
before the shuffle, and a vertex with very many links is one skewed key of a plain join, which
Spark splits. Each round is written to the shared folder. Rounds end once the links are stars already:
every vertex has one link down, to one that has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-least")
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "links-least")
    joined = down.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u != v"))


def _are_stars(links: DataFrame) -> bool:
    """Whether each vertex has at most one link down, and none if another has one down to it."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("top")).union(
        links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("top").alias("top")).where("down > 1 or down > 0 and top > 0").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest vertex that each linked vertex reaches. links: columns u and v."""
    now = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .where("u != v").distinct(), "links")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        now = stage(_small_star(stage(_large_star(now).distinct(), "links")).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        now.select("v", "v").distinct())
