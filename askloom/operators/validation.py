"""Checks of tables: ids, nulls, submissions, drift and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGETS = ("TargetRLF1", "TargetR1F1", "TargetLLM")


def build_submission(answers: DataFrame, key: str = "id", answer: str = "answer") -> DataFrame:
    """ID and one answer in every target; null becomes the empty text."""
    a = F.coalesce(F.col(answer), F.lit(""))
    return answers.select(F.col(key).alias("ID"), *[a.alias(t) for t in TARGETS])


def validate_submission(submission: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts: rows, duplicate, empty and null ids, unequal targets, empty answers, missing and extra ids."""
    own = submission.agg(
        F.count("*").alias("n_rows"),
        (F.count("ID") - F.count_distinct("ID")).alias("duplicate_ids"),
        F.count_if(F.coalesce(F.col("ID").cast("string"), F.lit("")) == "").alias("empty_ids"),
        F.count_if((F.col(TARGETS[0]) != F.col(TARGETS[1])) | (F.col(TARGETS[0]) != F.col(TARGETS[2]))).alias("unequal_targets"),
        F.count_if(F.col(TARGETS[0]) == "").alias("empty_answers"),
        F.round(F.avg(F.length(TARGETS[0])), 6).alias("mean_chars"),
    )
    missing = expected.select("ID").join(submission.select("ID"), "ID", "left_anti").agg(F.count("*").alias("missing_ids"))
    extra = submission.select("ID").join(expected.select("ID"), "ID", "left_anti").agg(F.count("*").alias("extra_ids"))
    return own.crossJoin(missing).crossJoin(extra)  # one row each


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def null_report(df: DataFrame) -> DataFrame:
    """column_name, nulls: nulls or NaN texts of each column."""
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().cast("long").alias("x")) for c in df.columns])).alias("y")
    return df.select(row).groupBy("y.column_name").agg(F.sum("y.x").alias("nulls"))


def drift(left: DataFrame, right: DataFrame, by: str, least: float = 0.1, gap: float = 0.15) -> DataFrame:
    """Shares of a column on both sides, with flags for small and diverging groups."""
    share = lambda d, n: d.groupBy(by).agg(F.count("*").alias("k")).crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select(by, (F.col("k") / F.col("all")).alias(n))
    both = share(left, "a").join(share(right, "b"), by, "full").select(by, F.round(F.coalesce("a", F.lit(0.0)), 6).alias("left_share"), F.round(F.coalesce("b", F.lit(0.0)), 6).alias("right_share"))
    return both.withColumns({"small": F.col("left_share") < least, "diverges": F.abs(F.col("left_share") - F.col("right_share")) > gap})


def canonical(columns: list[str]) -> Column:
    """A row as one text that tells nulls, empty texts and the columns' edges apart."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string"))) for c in columns])


def fingerprint(columns: list[str]) -> Column:
    """A column to aggregate: the same for the same rows in any order, another if a row occurs once more or less. The
    rows' hashes are added up (two sums of 64 bits each), so equal rows don't cancel, and nulls count."""
    row = canonical(columns)
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)


def digest_tree(df: DataFrame, key: str, columns: list[str], width: int = 1024, levels: int = 3) -> DataFrame:
    """level, node, digest: an ordered Merkle tree over ranges of a whole-number key. A node of level 1 is the SHA-256 of its
    `width` keys' rows in order, one of level n + 1 that of `width` nodes below; all that level `levels` has is one digest
    of the root (level 0, node 0). A row that repeats counts as often as it occurs; keys out of range fall in edge nodes."""
    rows = df.groupBy(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("at"), F.sha2(canonical(columns), 256).alias("h")).agg(F.count("*").alias("n"))
    line = lambda x: F.concat_ws(":", x["at"].cast("string"), x["h"], x["n"].cast("string"))
    made = None
    for level in range(1, levels + 2):
        node = F.floor(F.col("at") / width).cast("long") if level <= levels else F.lit(0).cast("long")
        held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "h", "n"))), line), ";")
        rows = rows.groupBy(node.alias("at")).agg(F.sha2(held, 256).alias("h")).withColumn("n", F.lit(1))
        part = rows.select(F.lit(level if level <= levels else 0).alias("level"), F.col("at").alias("node"), F.col("h").alias("digest"))
        made = part if made is None else made.unionByName(part)
    return made


def differing_ranges(left: DataFrame, right: DataFrame) -> DataFrame:
    """level, node of two digest trees whose digests differ or that one side lacks: where two tables have drifted apart."""
    both = left.withColumnRenamed("digest", "a").join(right.withColumnRenamed("digest", "b"), ["level", "node"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")


def within_tolerance(counts: DataFrame, by: str, target: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    """by, a share per split rounded to 4 places, and ok: no share is further than the tolerance from its target. counts: by and
    a column of counts per split; a group without rows has shares of 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in target), F.lit(0))
    share = {c: F.round(F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0)), total), F.lit(0.0)), 4) for c in target}
    own = counts.select(by, *[x.alias(f"{c}_share") for c, x in share.items()])
    ok = F.lit(True)
    for c, wanted in target.items():
        ok = ok & (F.round(F.abs(F.col(f"{c}_share") - wanted), 6) <= tolerance)
    return own.withColumn("ok", ok)
