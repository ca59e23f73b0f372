"""Lexical and dense similarity joins inside partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.operators.blocks import DENSE_ROWS, dense_scores, in_blocks, sparse_in_blocks, sparse_pairs
from askloom.operators.filed import TERMS, Filed, coded, filed, meet
from askloom.storage import Rounds, remove


def term_counts(docs: DataFrame, keys: list[str], grams: Column) -> DataFrame:
    """keys, term, tf: how often each document has each term."""
    return docs.select(*keys, F.explode(grams).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tallied(terms: pa.Array) -> pa.Array:
    """The distinct numbers of each list with their counts, sorted; a null list has none."""
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    value = terms.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(terms), dtype=np.int32), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    ends = np.searchsorted(row[first], np.arange(len(terms) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([value[first], np.diff(first, append=len(value)).astype(np.int32)], ["term", "tf"]))


def hashed_counts(docs: DataFrame, keys: list[str], grams: Column) -> DataFrame:
    """term_counts with terms as 64 bits of their hash, from lists that are written once, as fits and weights both read them."""
    return Rounds(docs.sparkSession).put("counts", hashed_lists(docs, keys, grams)).select(*keys, F.inline("x"))


def hashed_lists(docs: DataFrame, keys: list[str], grams: Column, *salt: str) -> DataFrame:
    """keys, x: the terms, as 64 bits of their hash, with tf, counted inside each document's own list, without a shuffle; salt:
    columns that are hashed too, so that a term of another group is another term."""
    listed = docs.select(*keys, F.transform(grams, lambda x: F.xxhash64(x, *salt)).alias("x"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keys), tallied(part["x"])], [*keys, "x"])

    kind = ", ".join(f"{c} {listed.schema[c].dataType.simpleString()}" for c in keys)
    return listed.mapInArrow(run, f"{kind}, x array<struct<term: bigint, tf: int>>")


def idf(counts: DataFrame, n_docs: DataFrame, min_df: int = 1, by: list[str] = ()) -> DataFrame:
    """term, idf = ln((1+N)/(1+df)) + 1 of the fitted documents; by: columns in which fits are separate."""
    df = counts.groupBy(*by, "term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    df = df.join(F.broadcast(n_docs), list(by)) if by else df.crossJoin(F.broadcast(n_docs))  # one row per fit
    return df.select(*by, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, idfs: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """keys, term, w: (1+ln tf)*idf, each document to unit length; unknown terms go before that."""
    raw = counts.join(idfs, [*by, "term"]).withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, *[c for c in by if c not in keys], "term", (F.col("raw") / norm).alias("w"))


def bm25_weights(counts: DataFrame, within: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, within, term, w of a pool's (id, within, term, tf): its dot product with a query's term counts is BM25, fitted
    inside each group. So sparse_top_k ranks by BM25 without a join of all postings of a common term."""
    size = counts.groupBy("id", within).agg(F.sum("tf").alias("len"))
    stats = size.groupBy(within).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = counts.groupBy(within, "term").agg(F.count("*").alias("df"))
    own = counts.join(size, ["id", within]).join(df, [within, "term"]).join(stats, within)
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return own.select("id", within, "term", part.alias("w"))


def top_k(pairs: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """pairs with rank (from 1) up to k; Spark limits each group before the shuffle."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, pool: DataFrame, k: int | None, within: str, drop_self: bool = False, whole_pool: bool = False, differ: str | None = None) -> DataFrame:
    """within, q, p, sim, rank: the k nearest (all, without a rank, if k is None) of the pool's (id, vec) for each query's
    with the same value of `within`. whole_pool: a query whose value no pool row has is matched against all rows.
    differ: a column in which a query and its neighbours must differ."""
    differ = "id" if drop_self else differ
    own = lambda x: x.select(*{within: 0, "id": 0, "vec": 0, differ or "id": 0})
    found = in_blocks(own(queries), own(pool), within, dense_scores, DENSE_ROWS, k, None, differ, whole_pool)
    return found if k is None else top_k(found, k, ["q"], [F.desc("sim"), F.asc("p")])


def as_vectors(weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, terms, w from (keys, term, w): a term is known by 64 bits of its hash."""
    return weights.groupBy(*keys).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")).alias("x")).select(*keys, F.col("x.t").alias("terms"), F.col("x.w").alias("w"))


def unit_vectors(counts: DataFrame, idfs: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """keys, terms, w of each document: tfidf() as vectors; the norm is taken inside a document's own array. by: columns,
    among the keys, in which fits are separate."""
    raw = counts.join(idfs, [*by, "term"]).select(*keys, F.xxhash64("term").alias("t"), ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    held = raw.groupBy(*keys).agg(F.collect_list(F.struct("t", "raw")).alias("x"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return held.select(*keys, F.col("x.t").alias("terms"), F.transform("x", lambda x: x["raw"] / F.col("norm")).alias("w"))


def tfidf_files(docs: DataFrame, within: str, grams: Column, min_df: int = 1, by_group: bool = False) -> Filed:
    """unit_vectors of docs (id, within, ...) in files by block, fitted on all of them, or by group. A vocabulary of up to TERMS terms is read by
    the workers, so terms are shuffled only to count documents; a larger one is joined."""
    spark, store = docs.sparkSession, Rounds(docs.sparkSession)
    by = [within] if by_group else []
    lists = store.put("counts", hashed_lists(docs, ["id", within], grams, *by))
    counts = lists.select("id", within, F.inline("x"))
    n_docs = docs.groupBy(*by).agg(F.count("*").alias("n"))
    known = store.put("idf", idf(counts, n_docs, min_df, by))
    if known.count() <= TERMS:
        held = filed(coded(lists, ["id", within], store.paths["idf"][-1]), within, docs, store.paths["idf"][-1])
    else:
        held = filed(unit_vectors(counts, known, ["id", within], by), within, docs)
    remove(spark, store.paths["counts"][-1])
    return held


def _sparse_found(queries: DataFrame, pool: DataFrame, k: int, within: str, drop_self: bool, written: bool = False) -> DataFrame:
    """Vectors are written once, unless they come from files, as they are counted and dealt."""
    if isinstance(queries, Filed):
        return meet(queries, pool, k, drop_self).withColumnRenamed("grp", within)
    if written:
        return sparse_in_blocks(queries, pool, within, k, "id" if drop_self else None)
    store = Rounds(queries.sparkSession)
    own = lambda x: x if "terms" in x.columns else as_vectors(x, ["id", within])
    q = store.put("queries", own(queries))
    p = q if pool is queries else store.put("pool", own(pool))
    found = sparse_in_blocks(q, p, within, k, "id" if drop_self else None)
    store.close()
    return found


def sparse_top_k(queries: DataFrame | Filed, pool: DataFrame | Filed, k: int, within: str, drop_self: bool = False, written: bool = False) -> DataFrame:
    """within, q, p, sim, rank: the k nearest with any shared term, in blocks; rows are (id, within, term, w >= 0) or vectors
    (id, within, terms, w), or both sides are Filed; written: vectors that are read from files."""
    found = _sparse_found(queries, pool, k, within, drop_self, written).drop("scored")
    return top_k(found, k, ["q"], [F.desc("sim"), F.asc("p")])


def pairs_scored(queries: DataFrame, pool: DataFrame, k: int, within: str, drop_self: bool = False) -> DataFrame:
    """within, n_pairs, n_scored: pairs of a group, and those of which sparse_top_k has to add up all terms."""
    found = _sparse_found(queries, pool, k, within, drop_self).groupBy(within).agg(F.sum("scored").alias("n_scored"))
    size = lambda x, n: x.groupBy(within).agg(F.count_distinct("id").alias(n))
    return size(queries, "nq").join(size(pool, "np"), within).join(found, within, "left").select(within, (F.col("nq") * F.col("np")).alias("n_pairs"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def sparse_at_least(vectors: DataFrame, least: float, digits: int = 9) -> DataFrame:
    """q, p, sim of all pairs of rows (id, term, w >= 0), or vectors (id, terms, w), with a dot product of at least `least`,
    each with itself too. Two blocks of rows meet in a task; pairs below the bound never leave it."""
    held = vectors if "terms" in vectors.columns else as_vectors(vectors, ["id"])
    return sparse_pairs(Rounds(vectors.sparkSession).put("vectors", held), least, digits)


def blend(dense: DataFrame, lexical: DataFrame, alpha: float) -> DataFrame:
    """(1-alpha)*dense + alpha*lexical; a pair that one side lacks counts 0 there."""
    both = dense.select("q", "p", F.col("sim").alias("d")).join(lexical.select("q", "p", F.col("sim").alias("l")), ["q", "p"], "full")
    return both.select("q", "p", ((1 - alpha) * F.coalesce("d", F.lit(0.0)) + alpha * F.coalesce("l", F.lit(0.0))).alias("sim"))


def margin(ranked: DataFrame) -> DataFrame:
    """q, p, sim, margin over the runner-up, from rows with rank."""
    best = ranked.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("p"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("sim"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("second"))
    return best.select("q", "p", "sim", (F.col("sim") - F.coalesce("second", F.lit(0.0))).alias("margin"))


def mutual_best(there: DataFrame, back: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs (q, p, sim) that are each other's first."""
    b = back.where("rank = 1").select(F.col("q").alias("p"), F.col("p").alias("q"))
    return there.where("rank = 1").where(F.col("sim") >= least).select("q", "p", "sim").join(b, ["q", "p"])

