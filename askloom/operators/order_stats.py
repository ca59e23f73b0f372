"""Exact order statistics by histograms that are refined around the wanted ranks, at any number of rows and groups.

For each wanted rank a group keeps the range in which its value must lie. A round counts the rows of all ranges in
`bins` bins, with partial sums before the shuffle, and takes the bin that holds the rank; its least and greatest value
are the next range. A range shrinks at each round, by about `bins` times, and is settled when it is one value. No task
holds a group and no group's values are sorted; tables of ranges have a row per group and rank.

Null and NaN values are left out; a group without values has no row. Null groups are a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.storage import Rounds

BINS = 1024
BROADCAST_ROWS = 100_000


def order_statistics(rows: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = BINS) -> DataFrame:
    """by, n and a column per entry of ranks: the value at the 0-based rank that the entry makes of the number of rows.
    Ranks out of range are moved to the nearest row."""
    store = Rounds(rows.sparkSession)
    own = rows.select(F.struct(F.col(by).alias("k")).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    own = store.put("values", own.groupBy("g", "v").agg(F.count("*").alias("c")))  # equal values count once a round
    base = own.groupBy("g").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.least(F.greatest(make(F.col("n")).cast("long"), F.lit(0)), F.col("n") - 1).alias("rank")) for i, make in enumerate(ranks.values())])).alias("a")
    asked = store.put("asked", base.select("g", "n", "lo", "hi", wanted).select("g", "n", "lo", "hi", "a.i", "a.rank"))
    while not (open_ := asked.where("lo < hi")).isEmpty():
        few = open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        met = own.join(F.broadcast(open_) if few else open_, "g").where("v >= lo AND v <= hi")
        at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        held = met.groupBy("g", "i", "n", "rank", at.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "i").orderBy("bin"))  # at most `bins` rows a rank
        held = held.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        narrowed = held.select("g", "n", "lo", "hi", "i", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
        asked = store.put("asked", narrowed.unionByName(asked.where("lo >= hi")))
    picked = [F.max(F.when(F.col("i") == i, F.col("lo"))).alias(name) for i, name in enumerate(ranks)]
    return asked.groupBy("g").agg(F.first("n").alias("n"), *picked).select(F.col("g.k").alias(by), "n", *ranks)


def percentiles(rows: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """by, n and a column per quantile, interpolated between the two rows next to rank (n - 1) * q."""
    low = {f"_lo_{name}": lambda n, q=q: F.floor((n - 1) * q) for name, q in quantiles.items()}
    high = {f"_hi_{name}": lambda n, q=q: F.ceil((n - 1) * q) for name, q in quantiles.items()}
    out = order_statistics(rows, by, value, low | high)

    def mixed(name: str, q: float) -> Column:
        share = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
        return (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * share).alias(name)

    return out.select(by, "n", *[mixed(name, q) for name, q in quantiles.items()])
