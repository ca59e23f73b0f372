"""BM25 pools and BERTScore reranking against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import text as X
from askloom.functions import vectors as V
from askloom.operators import rerank as K


def f1(a, b):
    """Greedy matching, one dot product at a time."""
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    p = sum(max(dot(x, y) for y in b) for x in a) / len(a)
    r = sum(max(dot(x, y) for x in a) for y in b) / len(b)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_bert_score_of_vectors(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 5))]
    rows = [(i, unit(1 + i % 4), unit(1 + i % 3)) for i in range(20)] + [(20, [], unit(2)), (21, None, unit(1)), (22, unit(3), [])]
    df = spark.createDataFrame(rows, "i int, a array<array<double>>, b array<array<double>>")
    for r in df.select("i", M.bert_score(F.col("a"), F.col("b")).alias("s")).collect():
        _, a, b = rows[r.i]
        if a is None:
            assert r.s is None
        else:
            assert tuple(r.s) == pytest.approx(f1(a, b) if a and b else (0.0, 0.0, 0.0))


def test_hashed_vectors():
    encode = V.HashedNgrams()
    made = encode(["running", "Running", "runner", "xyz", ""])
    assert made.shape == (5, 64) and np.allclose((made**2).sum(axis=1), 1) and np.allclose(made[0], made[1])
    assert made[0] @ made[2] > 0.3 > made[0] @ made[3]
    assert np.allclose(V.HashedNgrams()(["running"])[0], made[0]) and encode([]).shape == (0, 64)


def test_rerank_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    pool = [(i, "xy"[i % 2], text(rng.randrange(3, 12)), text(8)) for i in range(24)] + [(90, "alone", "abc", "x"), (91, None, "abc", "y"), (92, "x", None, "z")]
    df = spark.createDataFrame(pool, "id long, lang string, question string, answer string")
    want = {}
    for lang in "xy":
        docs = {i: q.split() for i, g, q, _ in pool if g == lang and q}
        avg = sum(map(len, docs.values())) / len(docs)
        df_of = lambda t: sum(t in d for d in docs.values())  # noqa: E731, B023
        for q, words in docs.items():
            score = {p: round(sum(words.count(t) * math.log(1 + (len(docs) - df_of(t) + 0.5) / (df_of(t) + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in set(words) & set(d)), 6) for p, d in docs.items() if p != q}
            want[q] = [p for p in sorted(score, key=lambda p: (-score[p], p)) if score[p] > 0][:3]
    pools = K.reference_pool(df, X.words, 3)
    got: dict = {}
    for r in sorted(pools.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append(r.p)
    assert got == {q: p for q, p in want.items() if p}
    cands = [(i, k, text(6)) for i in list(range(24)) + [90] for k in range(3)] + [(0, 3, None), (1, 3, "")]
    answers = df.select(F.col("id").alias("p"), "answer")
    best = K.rerank(spark.createDataFrame(cands, "q long, k int, cand string"), pools, answers, V.bert_scorer(), batch=4)
    encode, stored = V.HashedNgrams(), {i: a for i, _, _, a in pool}
    for r in best.collect():
        own = {k: c for q, k, c in cands if q == r.q}
        if not got.get(r.q):
            assert (r.k, r.score) == (0, None)
            continue
        mean = {k: sum(f1(encode(c.split()), encode(stored[p].split()))[2] if c else 0.0 for p in got[r.q]) / len(got[r.q]) for k, c in own.items()}
        top = max(mean, key=lambda k: (round(mean[k], 9), -k))
        assert r.k == top and r.score == pytest.approx(mean[top], abs=1e-8)
    assert best.count() == 25
