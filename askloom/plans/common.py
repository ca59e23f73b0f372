"""Tables and views that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.operators.splits import ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_id, turn, input, output, subset: each user turn with the assistant turn that follows at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").withColumns({"nr": F.lead("role").over(w), "na": F.lead("text").over(w)})
    own = own.where("role = 'user' AND nr = 'assistant'")
    row_id = F.concat(F.lit("Q"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    return own.select(row_id.alias("id"), "conv_id", "turn", F.col("text").alias("input"), F.col("na").alias("output"), F.concat(F.lit("s"), F.col("conv_id") % 4).alias("subset"))


QA = """qa AS (SELECT 'Q' || lpad(conv_id::VARCHAR, 8, '0') || '_' || lpad(turn::VARCHAR, 4, '0') AS id, conv_id, turn, text AS input, na AS output, 's' || (conv_id % 4) AS subset
    FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS na FROM conversations) WHERE role = 'user' AND nr = 'assistant')"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_pool with rn, the row's number in its subset by id; conversations of 64 ids each are numbered together, so no task
    holds a subset."""
    return ordinal(qa_pool(spark, sf_dir), "subset", F.floor(F.col("conv_id") / 64), [F.col("id")])


def previous_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_pool with pred: the answer of the row before in the subset, where there is one."""
    rows = numbered(spark, sf_dir)
    before = rows.select("subset", (F.col("rn") + 1).alias("rn"), F.col("output").alias("pred"))
    return rows.join(before, ["subset", "rn"]).where("pred IS NOT NULL").drop("rn", "n")


PREV = QA + """, prev AS (SELECT * FROM (SELECT *, lag(output) OVER (PARTITION BY subset ORDER BY id) AS pred FROM qa) WHERE pred IS NOT NULL)"""


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '\s+'), lambda w: w <> '')"


OVERLAP = """ov AS (SELECT id, sum(least(a, b)) AS ov FROM (
        SELECT id, w, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 'r') AS b FROM (
          SELECT id, unnest(pt) AS w, 'p' AS side FROM tok UNION ALL SELECT id, unnest(rt), 'r' FROM tok) GROUP BY id, w) GROUP BY id)"""
