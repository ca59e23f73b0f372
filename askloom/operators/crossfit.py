"""Cross-fitted candidate lists: a ranker may train on the pool's own questions, with lists from models that did not see them.

A fold's model is fitted on the pool without the fold. Its questions search the whole pool but themselves; evaluation
questions are searched by every fold's model, and their lists are fused by the mean of the folds' scores, so that they
look like what a ranker was trained on. All folds are fitted and searched in the same joins, with the fold as a part of
the group, so their number adds rows and no passes. Models here are tf-idf weights; unknown terms count nothing.

Null inputs have no terms and no list. A fold without a question has no training list; an empty pool gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.operators import ranking as K
from askloom.operators import retrieval as R
from askloom.operators import selection as S
from askloom.storage import Rounds


def cross_fitted(pool: DataFrame, questions: DataFrame, words: Callable[[Column], Column], folds: int = 5, k: int = 10, min_df: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training lists (fold, q, p, sim, rank) of the pool's questions and fold lists of the evaluation questions, from pool
    and questions (id, subset, input). Ids of the two must differ."""
    own = pool.select("id", "subset", "input", K.question_fold(F.col("id"), folds).alias("own"), F.lit(True).alias("stored"))
    rows = own.unionByName(questions.select("id", "subset", "input", F.lit(-1).alias("own"), F.lit(False).alias("stored")))
    counts = R.hashed_counts(rows.where("input IS NOT NULL"), ["id", "subset", "own", "stored"], words(F.col("input")))
    copies = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    seen = copies.where("stored AND own <> fold")
    sizes = pool.select(K.question_fold(F.col("id"), folds).alias("own")).groupBy("own").agg(F.count("*").alias("c"))
    every = sizes.agg(F.sum("c").alias("all"))
    n_docs = sizes.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")).join(sizes.withColumnRenamed("own", "fold"), "fold", "left").crossJoin(every)  # a row a fold
    n_docs = n_docs.select("fold", (F.col("all") - F.coalesce("c", F.lit(0))).alias("n"))
    vectors = R.unit_vectors(copies, R.idf(seen, n_docs, min_df, ["fold"]), ["id", "subset", "own", "stored", "fold"], ["fold"])
    vectors = vectors.withColumn("grp", F.concat_ws("|", "fold", "subset")).select("id", "grp", "terms", "w", "own", "fold", "stored")
    vectors = Rounds(pool.sparkSession).put("vectors", vectors)  # once: both searches read them, and a search not asked for costs nothing
    own = lambda x: x.select("id", "grp", "terms", "w")
    store = own(vectors.where("stored"))
    trained = R.sparse_top_k(own(vectors.where("stored AND own = fold")), store, k, "grp", drop_self=True, written=True)
    # a question of several groups has a list in each: the group is a part of its key
    keyed = vectors.where("NOT stored").withColumn("id", F.concat_ws("#", "fold", "id"))
    evaluated = R.sparse_top_k(own(keyed), store, k, "grp", written=True)
    per_fold = evaluated.select(F.split("q", "#")[0].cast("int").alias("fold"), F.expr("substring(q, instr(q, '#') + 1)").alias("q"), "p", "sim", "rank")
    return trained.select(F.split("grp", r"\|")[0].cast("int").alias("fold"), "q", "p", "sim", "rank"), per_fold


def fused(per_fold: DataFrame, k: int = 10) -> DataFrame:
    """q, p, score, rank: the folds' lists of a question by mean score; what a fold's list lacks gets its least score."""
    return S.fuse(per_fold.select("q", "fold", "p", F.col("sim").alias("score")), k, 8)


def joined(lists: DataFrame, by: list[str], score: str = "sim") -> DataFrame:
    """Lists as text: p:score, best first, parted by bars."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("rank", "p", F.col(score).alias("s")))), lambda x: F.concat_ws(":", x["p"], F.format_string("%.6f", x["s"])))
    return lists.groupBy(*by).agg(F.array_join(items, "|").alias("list"))
