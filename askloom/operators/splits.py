"""Splits, samples and folds by a hash of the key: the same rows on every run, at every size and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def ordinal(df: DataFrame, by: str, bucket: Column, order: list[Column]) -> DataFrame:
    """df with rn (from 1, by bucket and then order) and n within each group. Rows are ranked inside buckets; what lies
    before a bucket is added from the table of bucket sizes, so no task has to hold a whole group. bucket rises with the
    order wanted; a group has few buckets beside its rows."""
    own = df.withColumn("_bucket", bucket)
    sizes = own.groupBy(F.col(by).alias("_by"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_ahead": F.coalesce(F.sum("_size").over(before), F.lit(0)), "n": F.sum("_size").over(Window.partitionBy("_by"))}).drop("_size")
    inside = own.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)))
    joined = inside.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn("rn", (F.col("_rn") + F.col("_ahead")).cast("long")).drop("_by", "_b", "_bucket", "_rn", "_ahead")


def ranked(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """df with rn (from 1, in hash order) and n within each group; 4,096 buckets of a group by the hash's first digits."""
    return ordinal(df, by, F.substring(order_key(seed, key), 1, 3), [order_key(seed, key), F.col(key)])


def hold_out(df: DataFrame, by: str, key: str, fraction: float, seed: int = 1234) -> DataFrame:
    """df with held: max(1, round(fraction of the group)) rows of each group; halves round to even."""
    return ranked(df, by, key, seed).withColumn("held", F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).drop("rn", "n")


def three_way(df: DataFrame, by: str, key: str, ratios: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """df with split: train, val or test; ratios must add up to 1."""
    if abs(sum(ratios) - 1) > 0.001:
        raise ValueError(f"ratios add up to {sum(ratios)}")
    own = ranked(df, by, key, seed)
    a, b = F.bround(F.col("n") * ratios[0]), F.bround(F.col("n") * (ratios[0] + ratios[1]))
    return own.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "val").otherwise("test")).drop("rn", "n")


def folds(df: DataFrame, by: str, key: str, k: int, seed: int = 7) -> DataFrame:
    return ranked(df, by, key, seed).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn", "n")


def sample(df: DataFrame, by: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group: a sampling operator, so the limit is its purpose."""
    order = Window.partitionBy(by).orderBy(order_key(seed, key), key)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")  # Spark limits each group before the shuffle


def disjoint(splits: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
