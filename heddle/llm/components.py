"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import settle


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``u, root`` for every node of ``edges`` (``u``, ``v``) but the roots; a root is its component's least node.

    Each half round sends every neighbour to the least one (first upwards, then downwards), which
    needs only the least neighbour per node: a hub meets as a minimum, never as a list. Each round
    is written, so it can be read again after a loss. It ends when a round changes nothing; ``most_rounds`` is
    far above what graphs need (rounds grow with the logarithm of a component's size), and reaching it is an error, never a result.
    """
    now = settle(_turned(edges).distinct())
    sign = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign or not seen[0]:
            return now.select("u", F.col("v").alias("root"))
        sign = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(_turned(small.union(lows.select("u", F.col("m").alias("v")))).distinct())
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
