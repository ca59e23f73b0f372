"""Scores of texts against references."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions.vectors import greedy_batch

# fixed values: weights of the total
W_R1, W_RL, W_JUDGE = 0.37, 0.37, 0.26
W_PROXY = (0.3125, 0.3125, 0.375)


def f1(overlap: Column, n_pred: Column, n_ref: Column) -> Column:
    """2PR/(P+R) with P and R the overlap per side: 2*overlap/(n_pred+n_ref); 0 if a side is empty."""
    return F.when((n_pred > 0) & (n_ref > 0), 2.0 * overlap / (n_pred + n_ref)).otherwise(0.0)


def _plain(tokens) -> list:
    return tokens.tolist() if isinstance(tokens, np.ndarray) else list(tokens)


def numbered(tokens: Column) -> Column:
    """Tokens as 64 bits of their hash: overlaps need no more, and a batch of numbers takes an eighth of one of strings."""
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _common_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(Counter(_plain(x)) & Counter(_plain(y))).total() if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)])


def common(pred: Column, ref: Column) -> Column:
    """Multiset overlap of two token arrays, in Arrow batches: built-in functions count one token in time linear in the text."""
    return F.pandas_udf(_common_batch, "int")(pred, ref)


def rouge1(pred: Column, ref: Column) -> Column:
    return f1(common(pred, ref), F.size(pred), F.size(ref))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by one bit per token of b."""
    places: dict[str, int] = {}
    for i, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for t in a:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _lcs_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(_plain(x), _plain(y)) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)])


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, in Arrow batches."""
    return F.pandas_udf(_lcs_batch, "int")(a, b)


def rouge_l(pred: Column, ref: Column) -> Column:
    """By longest common subsequence, in Arrow batches: built-in functions would need a nested fold per pair of tokens."""
    return f1(lcs(pred, ref), F.size(pred), F.size(ref))


def answer_overlap(pred: Column, ref: Column) -> Column:
    """The mean of both ROUGE scores of two token arrays."""
    return (rouge1(pred, ref) + rouge_l(pred, ref)) / 2


def total(r1: Column, rl: Column, judge: Column) -> Column:
    """Weighted total; null without a judge's score."""
    return W_R1 * r1 + W_RL * rl + W_JUDGE * judge


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def bert_score(pred: Column, ref: Column) -> Column:
    """precision, recall, f1 from two arrays of unit token vectors, as one matrix product a pair in Arrow batches."""
    return F.arrow_udf(_greedy, "precision double, recall double, f1 double")(pred, ref)


def _greedy(pred: pa.Array, ref: pa.Array) -> pa.Array:
    return greedy_batch(pred, ref)


def proxy(r1: Column, rl: Column, bert: Column) -> Column:
    """A total of three scores without a judge."""
    return W_PROXY[0] * r1 + W_PROXY[1] * rl + W_PROXY[2] * bert


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors that the mask keeps; zeros if it keeps none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: x * 0.0)
    return F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b), lambda s: F.transform(s, lambda a: F.coalesce(F.try_divide(a, F.size(kept)), F.lit(0.0))))
