"""Sparse blocks against a dense product: common terms as columns, rare ones by postings, pairs near a bound scored exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.operators import blocks as B
from askloom.operators import retrieval as R


def corpus(n, terms, seed):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, terms + 1)
    chance /= chance.sum()
    wide = np.array([np.bincount(rng.choice(terms, 40, p=chance), minlength=terms) for _ in range(n)], float)
    wide[n // 2 :] = wide[: n - n // 2]
    wide[n // 2 :, 3] += rng.integers(0, 9, n - n // 2)
    wide[5] = 0.0
    wide[wide.any(axis=1)] /= np.linalg.norm(wide[wide.any(axis=1)], axis=1)[:, None]
    return wide


def table(wide):
    lists = [np.flatnonzero(row) for row in wide]
    return pa.table({"id": np.arange(len(wide)), "terms": pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), "w": pa.array([row[x].tolist() for row, x in zip(wide, lists, strict=True)], pa.list_(pa.float64()))})


@pytest.mark.parametrize("head", [0, 3, 1024])
def test_near_pairs_and_best_of_blocks(monkeypatch, head):
    monkeypatch.setattr(B, "HEAD", head)
    monkeypatch.setattr(B, "CELLS", 900)
    monkeypatch.setattr(B, "PRODUCTS", 50)
    wide = corpus(80, 300, 3)
    left, right = table(wide[:50]), table(wide[30:])
    sims = wide[:50] @ wide[30:].T
    i, j, found = B.sparse_near(left, right, 0.8, 9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(np.round(sims, 9) >= 0.8)), strict=True))
    assert found == pytest.approx(sims[i, j], abs=1e-12)
    own = right.set_column(0, "id", pa.array(np.arange(30, 80)))
    i, j, found, _ = B.sparse_best(left, own, 4, "id", 6)
    sims[np.arange(30, 50), np.arange(20)] = 0.0
    want = [(a, b) for a in range(50) for b in sorted(range(50), key=lambda b: (-round(sims[a, b], 6), b))[:4] if sims[a, b] > 0]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
    i, j, _ = B.sparse_near(table(wide[5:6]), right, 0.8, 9)
    assert not len(i)


def test_near_pairs_of_half_the_cells(spark, monkeypatch):
    monkeypatch.setattr(B, "SPARSE_ROWS", 13)
    wide = corpus(60, 40, 8)
    rows = [(int(i), f"t{t}", float(wide[i, t])) for i, t in zip(*np.nonzero(wide), strict=True)]
    got = R.sparse_at_least(spark.createDataFrame(rows, "id long, term string, w double"), 0.8)
    assert sorted((r.q, r.p) for r in got.select("q", "p").collect()) == sorted(zip(*(x.tolist() for x in np.nonzero(np.round(wide @ wide.T, 9) >= 0.8)), strict=True))
    assert got.where(F.col("q") == F.col("p")).count() == 59


def test_equal_nulls_do_not_bar():
    a, b = B.codes(pa.chunked_array([["x", None, "y"]]), pa.chunked_array([["y", None]]))
    assert (a[:, None] == b[None, :]).tolist() == [[False, False], [False, False], [True, False]]


@pytest.mark.parametrize("k", [1, 3])
def test_only_maxima_of_groups_are_ordered(monkeypatch, k):
    wide = corpus(400, 300, 5)
    left, right = table(wide[:200]), table(wide[200:])
    right = right.set_column(0, "id", pa.array(np.arange(200, 400)))
    monkeypatch.setattr(B, "CELLS", 200 * 90)
    ordered, plain = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **b: ordered.append(x.size) or plain(x, *a, **b))
    there, back = B.sparse_best(left, right, k, "id", 6, True)
    sims = np.round(wide[:200] @ wide[200:].T, 6)
    for got, cells in ((there, sims), (back, sims.T)):
        want = [(a, b) for a in range(200) for b in sorted(range(200), key=lambda b: (-cells[a, b], b))[:k] if cells[a, b] > 0]
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
    assert sum(ordered) < 200 * 200  # it was every cell, twice
