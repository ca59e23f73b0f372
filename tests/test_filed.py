"""Sparse vectors in files by block against brute force: no row is copied for the blocks that it meets."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import blocks as B
from askloom.operators import filed as FD
from askloom.operators import retrieval as R


def texts(n):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    return [(f"Q{i:03d}", "s" + str(i % 3) if i % 3 else "s0", " ".join(rng.choices(words, k=rng.randrange(1, 9))) if i % 17 else (None if i % 2 else " ")) for i in range(n)]


def brute(rows, k, min_df):
    tf = {i: Counter((t or "").split()) for i, _, t in rows}
    df = Counter(w for c in tf.values() for w in c)
    vec = {}
    for i, c in tf.items():
        raw = {w: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items() if df[w] >= min_df}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vec[i] = {w: x / norm for w, x in raw.items()}
    group = {i: g for i, g, _ in rows}
    out = set()
    for q in vec:
        sims = [(-round(s, 6), p) for p in vec if p != q and group[p] == group[q] and (s := sum(x * vec[p].get(w, 0.0) for w, x in vec[q].items())) > 0]
        out |= {(q, p, -s, r + 1) for r, (s, p) in enumerate(sorted(sims)[:k])}
    return out


@pytest.mark.parametrize(("size", "bands", "held", "terms"), [(1 << 13, 6, 1 << 22, 1 << 22), (9, 2, 1 << 22, 1 << 22), (9, 3, 9, 1 << 22), (9, 6, 1 << 22, 0)])
def test_lists_from_files_are_those_of_brute_force(spark, monkeypatch, size, bands, held, terms):
    monkeypatch.setattr(B, "SPARSE_ROWS", size)
    monkeypatch.setattr(FD, "BANDS", bands)
    monkeypatch.setattr(FD, "HELD", held)
    monkeypatch.setattr(R, "TERMS", terms)
    rows = texts(120)
    docs = spark.createDataFrame([*rows, ("Q999", None, None)], "id string, subset string, input string")
    files = R.tfidf_files(docs.where("subset IS NOT NULL"), "subset", X.words(F.col("input")), 2)
    found = R.sparse_top_k(files, files, 4, "subset", drop_self=True)
    got = {(r.q, r.p, r.sim, r["rank"]) for r in found.collect()}
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in brute(rows, 4, 2)}
    assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in brute(rows, 4, 2)), abs=1e-5)


def test_rows_are_not_copied_for_the_blocks_they_meet(spark, monkeypatch):
    monkeypatch.setattr(B, "SPARSE_ROWS", 5)
    rows = [(f"q{i}", "g" if i else None, [i % 7, 9], [0.6, 0.8]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, g string, terms array<long>, w array<double>")
    found = R.sparse_top_k(df, df, 3, "g", drop_self=True)
    assert "CoGroups" not in found._jdf.queryExecution().toString()  # blocks were shuffled once for each block they met
    assert found.groupBy("q").count().where("count = 3").count() == 59
    other = df.where("id IN ('q1', 'q2')")
    assert R.sparse_top_k(other, df, 50, "g").groupBy("q").count().where("count = 50").count() == 2
    assert R.sparse_top_k(df.where("false"), df, 3, "g").count() == R.sparse_top_k(other, df.where("false"), 3, "g").count() == 0


def test_floors_leave_out_only_what_cannot_be_listed():
    import numpy as np
    import pyarrow as pa

    side = lambda ids: pa.table({"id": ids, "terms": pa.array([[1, i + 2] for i in ids], pa.list_(pa.int64())), "w": pa.array([[i / 100, 1.0] for i in ids], pa.list_(pa.float64()))})
    left, right = side(list(range(1, 9))), side(list(range(20, 60)))
    plain = B.sparse_best(left, right, 3, "id", 6, True)
    low = B.sparse_best(left, right, 3, "id", 6, True, (np.zeros(8), np.zeros(40)))
    assert [x.tolist() for x in low[0][:3]] == [x.tolist() for x in plain[0][:3]]
    high = B.sparse_best(left, right, 3, "id", 6, True, (np.full(8, 0.5), np.full(40, 0.5)))
    assert not len(high[0][0]) and not len(high[1][0])
    kth = B.sparse_best(left, right, 3, "id", 6, True, (plain[0][2][2::3], np.zeros(40)))
    assert [x.tolist() for x in kth[0][:3]] == [x.tolist() for x in plain[0][:3]]  # a tie with the floor stays


def test_texts_are_attached_in_tasks(spark, monkeypatch):
    """Both texts of a pair come from files; null keys, unknown keys and groups without files give null."""
    monkeypatch.setattr(B, "SPARSE_ROWS", 4)
    rows = [(f"q{i}", "ab"[i % 2], None if i == 4 else f"text {i}") for i in range(40)]
    texts = FD.filed(spark.createDataFrame(rows, "id string, g string, t string"), "g")
    pairs = [(g, f"q{i}", f"q{j}") for i in range(40) for j in range(40) for g in "ab"[i % 2] if i % 2 == j % 2] + [("a", "q0", None), ("a", "none", "q2"), ("z", "q0", "q2"), (None, "q0", "q2")]
    got = FD.attached(spark.createDataFrame(pairs, "g string, q string, p string"), "g", ("q", texts, {"t": "x"}), ("p", texts, {"t": "y"}))
    held = {(g, i): t for i, g, t in rows}
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((g, q, p, held.get((g, q)), held.get((g, p))) for g, q, p in pairs), key=key)


@pytest.mark.parametrize("name", ["vote_answer", "agree_pick", "mbr_medoid", "pool_weighted"])
def test_lists_do_not_carry_texts_through_shuffles(spark, monkeypatch, name):
    """No table that is joined or grouped holds an answer: they are read from files after the lists are cut."""
    import __spark_entry__ as entry
    from askloom.plans import candidate_queries as C

    asked = []
    plain = C.attached
    monkeypatch.setattr(C, "attached", lambda pairs, *a: asked.append(pairs) or plain(pairs, *a))
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert asked and not {"answer", "own", "other", "output"} & set(asked[0].columns)


def test_candidates_features_are_joined_by_ids(spark, monkeypatch):
    """Pairs meet vectors and texts in tasks; what is shuffled for a candidate has numbers and ids only."""
    import __spark_entry__ as entry
    from askloom.operators import ranking as K

    asked = []
    plain = K.attached
    monkeypatch.setattr(K, "attached", lambda pairs, *a: asked.append(pairs) or plain(pairs, *a))
    out = entry.queries()["candidate_features"](spark, "/root/testdata/sf0.001")
    assert out.count() == out.select("q", "answer").distinct().count() > 0
    assert len(asked) == 3 and not any({"answer", "own_answer", "terms", "w", "_qt"} & set(x.columns) for x in asked)


def test_equal_terms_of_groups_have_their_own_fit(spark):
    docs = spark.createDataFrame([("a", "x", "u v"), ("b", "x", "u"), ("c", "y", "u u"), ("d", "y", "w"), ("e", "y", "w u")], "id string, subset string, t string")
    files = R.tfidf_files(docs, "subset", X.words(F.col("t")), by_group=True)
    idf = {round(r.idf, 9) for r in spark.read.parquet(files.idf).collect()}
    assert idf == {round(math.log((1 + n) / (1 + df)) + 1, 9) for n, df in ((2, 2), (2, 1), (3, 2))}
    assert files.sizes.count() == 2


def test_near_copies_are_compared_in_their_subset_only(spark, monkeypatch):
    """Echo features read blocks of answers from files; before, each was shuffled once for each block of the whole table."""
    from askloom.operators import ranking as K

    monkeypatch.setattr(B, "SPARSE_ROWS", 3)
    rows = [(f"q{i:02d}", "st"[i % 2], ["a b c d e", "a b c d f", "x y", None][i % 4] if i < 16 else f"lone{i}") for i in range(30)]
    pool = spark.createDataFrame(rows, "id string, subset string, output string")
    out = K.echo_features(pool.selectExpr("id AS q", "output AS answer").where("output IS NOT NULL"), pool, X.words_plain(F.col("t")))
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    assert {r.q: round(math.exp(r.l_echo)) for r in out.collect()} == {i: 4 if int(i[1:]) < 16 else 1 for i, _, t in rows if t}


def test_reranking_reads_texts_from_files(spark, monkeypatch):
    from askloom.functions import vectors as V
    from askloom.operators import rerank as K

    monkeypatch.setattr(B, "SPARSE_ROWS", 3)
    answers = spark.createDataFrame([(f"q{i}", "g", f"word{i % 3} word{i % 5} tail") for i in range(12)], "id string, subset string, output string")
    cands = spark.createDataFrame([(f"q{i}", "g", k, f"q{(i + 2 + 3 * k) % 12}") for i in range(12) for k in (0, 1)], "q string, subset string, k int, aid string")
    pools = spark.createDataFrame([(f"q{i}", f"q{(i + s) % 12}") for i in range(11) for s in (1, 4)], "q string, p string")
    got = K.rerank_files(cands, pools, FD.filed(answers, "subset"), "output", V.bert_scorer())
    texted = cands.join(answers.selectExpr("id AS aid", "output AS cand"), "aid").select("q", "k", "cand")
    want = K.rerank(texted, pools, answers.selectExpr("id AS p", "output AS answer"), V.bert_scorer())
    assert sorted((r.q, r.k, r.cand, r.score) for r in got.where("q <> 'q11'").collect()) == sorted((r.q, r.k, r.cand, r.score) for r in want.where("q <> 'q11'").collect())
    assert got.where("q = 'q11' AND score IS NULL AND k = 0").count() == 1
