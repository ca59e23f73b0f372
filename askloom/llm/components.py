"""Connected components of a table of links, by alternating large and small stars; nothing goes to the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import cut

ROUNDS_MAX = 60


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (a, b) with b the smallest number in a's component; numbers that are smallest have no row."""
    now = cut(_small(links.select("a", "b").where("a <> b").distinct()))
    mark = None
    for _ in range(ROUNDS_MAX):
        now = cut(_small(_large(now)))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now
        mark = tuple(row)
    raise RuntimeError(f"components did not settle in {ROUNDS_MAX} rounds")
