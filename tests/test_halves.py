"""Blocks that meet once for both directions, and terms counted inside their lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import blocks as B
from askloom.operators import retrieval as R
from tests.test_blocks import corpus, table


@pytest.mark.parametrize("k", [1, 4, 60])
@pytest.mark.parametrize("cells", [1 << 22, 600])
def test_both_directions_from_the_same_scores(monkeypatch, k, cells):
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "HEAD", 5)
    wide = corpus(90, 300, 4)
    left, right = table(wide[:50]), table(wide[50:])
    there, back = B.sparse_best(left, right, k, None, 6, True)
    for got, want in ((there, B.sparse_best(left, right, k, None, 6)), (back, B.sparse_best(right, left, k, None, 6))):
        assert got[0].tolist() == want[0].tolist()
        assert got[1].tolist() == want[1].tolist()
        assert got[2] == pytest.approx(want[2], abs=1e-6)


def test_a_table_with_itself_meets_half_of_the_cells(spark, monkeypatch):
    monkeypatch.setattr(B, "SPARSE_ROWS", 20)
    wide = corpus(70, 60, 6)
    rows = table(wide).to_pylist()
    df = spark.createDataFrame([(x["id"], "g", x["terms"], x["w"]) for x in rows], "id long, g string, terms array<long>, w array<double>")
    got = B.sparse_in_blocks(df, df, "g", 3, "id")
    blocks = -(-len(rows) // 20)
    assert got.where("scored > 0").count() <= blocks * (blocks + 1)  # a count a direction; blocks ** 2 tasks would give more rows of equal pairs
    assert got.select("q", "p").distinct().count() == got.count()
    first = {r.q: r.p for r in R.top_k(got, 1, ["q"], [F.desc("sim"), F.asc("p")]).collect()}
    sims = np.round(wide @ wide.T, 6)
    np.fill_diagonal(sims, 0)
    assert first == {int(a): int(np.argmax(sims[a])) for a in range(70) if sims[a].any()}


def test_counts_inside_lists(spark):
    assert R.tallied(pa.array([[5, 3, 5], None, [], [5]], pa.list_(pa.int64()))).to_pylist() == [[{"term": 3, "tf": 1}, {"term": 5, "tf": 2}], [], [], [{"term": 5, "tf": 1}]]
    assert len(R.tallied(pa.array([[]], pa.list_(pa.int64())))) == 1
    docs = spark.createDataFrame([("a", "x y x"), ("b", None), ("c", ""), ("d", "y")], "id string, t string")
    got = R.hashed_counts(docs, ["id"], X.words(F.col("t"))).collect()
    assert sorted((r.id, r.tf) for r in got) == [("a", 1), ("a", 2), ("d", 1)]
    assert len({r.term for r in got}) == 2


def test_an_ngram_is_hashed_once_and_words_survive_a_full_table(monkeypatch):
    from askloom.functions import vectors as V

    asked = []
    signs = V.HashedNgrams.signs
    monkeypatch.setattr(V.HashedNgrams, "signs", lambda self, grams: asked.extend(grams) or signs(self, grams))
    texts = ["running runner run", "runs running xyz", "other runner words", "other xyz Run"]
    encode = V.HashedNgrams()
    made = [encode(t.split()) for t in texts]
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(V, "SEEN_MAX", 3)
    small = V.HashedNgrams()
    for t, rows in zip(texts, made, strict=True):
        assert np.array_equal(small(t.split()), rows)
    one = signs(encode, ["<run>", "<r", "ru", "un", "n>", "<ru", "run", "un>", "<run", "run>"]).sum(axis=0, dtype=float)
    assert np.array_equal(made[0][2], one / np.sqrt(one @ one))


def test_tokenizer_columns_send_numbers_and_not_strings(spark, monkeypatch):
    from askloom.functions import metrics as M
    from askloom.operators import reports as T

    kinds = []
    rouge1 = M.rouge1
    df = spark.createDataFrame([("s", "a b a", "a a c"), ("t", "", "x"), ("t", None, "x"), ("t", "x y", "y x")], "g string, p string, r string")
    monkeypatch.setattr(M, "rouge1", lambda a, b: kinds.append((a, b)) or rouge1(a, b))
    got = {r.g: r for r in T.compare_tokenizers(df, "g", "p", "r").collect()}
    assert got["s"].whitespace == pytest.approx(M.W_R1 * 2 / 3 + M.W_RL * 2 / 3, abs=1e-6)
    assert got["t"].whitespace == pytest.approx((M.W_R1 + M.W_RL / 2) / 3, abs=1e-6)
    assert len(kinds) == 4
    assert df.select(M.numbered(X.words(F.col("p"))).alias("x")).schema["x"].dataType.simpleString() == "array<bigint>"
