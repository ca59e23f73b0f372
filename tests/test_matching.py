"""The auction's assignments against an exact solver over all subsets of the objects."""

from __future__ import annotations

import random
from functools import cache

import pytest

from askloom.operators import matching as A


def best_total(sims, alone):
    """Greatest total of (sim - alone) over assignments of (q, p) pairs, each used once."""
    q, p = sorted({x for x, _ in sims}), sorted({y for _, y in sims})

    @cache
    def go(i, used):
        if i == len(q):
            return 0.0
        out = go(i + 1, used)
        for j, y in enumerate(p):
            if not used >> j & 1 and (q[i], y) in sims:
                out = max(out, sims[q[i], y] - alone + go(i + 1, used | 1 << j))
        return out

    return go(0, 0)


def test_totals_are_greatest(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g, (n, m, share) in enumerate([(7, 9, 1.0), (9, 6, 1.0), (8, 8, 1.0), (8, 7, 0.4), (1, 5, 1.0), (6, 6, 0.3)]):
        # few distinct values: many ties
        sims = {(q, 100 + p): rng.choice([-0.5, 0.1, 0.3, 0.3, 0.7, round(rng.random(), 6)]) for q in range(n) for p in range(m) if rng.random() < share}
        group = None if g == 1 else f"g{g}"
        rows += [(group, 1000 * g + q, 1000 * g + p, s, "clash") for (q, p), s in sims.items()]
        want[group] = sims
    rows += [("g0", 0, 100, -0.9, "clash"), ("g0", None, 100, 1.0, "x"), ("g0", 1, None, 1.0, "x"), ("g0", 1, 101, None, "x"), ("low", 1, 2, -2.0, "x")]
    pairs = spark.createDataFrame(rows, "grp string, q long, p long, sim double, b string")
    for alone in (-1.0, 0.2):
        got = A.one_to_one(pairs, "grp").collect() if alone == -1.0 else A.one_to_one(pairs, "grp", alone).collect()
        assert len({r.q for r in got}) == len({r.p for r in got}) == len(got)
        for g, sims in enumerate(want.values()):
            own = {(r.q % 1000, r.p % 1000): r.sim for r in got if r.q // 1000 == g and not (r.q == 1 and r.p == 2)}
            assert all(sims[x] == s for x, s in own.items())
            assert sum(s - alone for s in own.values()) == pytest.approx(best_total(sims, alone), abs=1e-5), (g, alone)
    assert A.one_to_one(pairs.where("false"), "grp").count() == 0


@pytest.mark.parametrize("size", [1 << 21, 60])
def test_rounds_do_not_grow_with_bids(spark, monkeypatch, size):
    """Near equal similarities raise prices in many small steps: blocks settle them, not tables of a round each."""
    import numpy as np

    rng = np.random.default_rng(5)
    sims = np.round(0.5 + rng.random((24, 24)) / 1000, 6)
    monkeypatch.setattr(A, "PAIRS", size)
    monkeypatch.setattr(A, "ROUNDS_MAX", 3 if size > 60 else 200)
    pairs = spark.createDataFrame([("g", i, j, float(sims[i, j])) for i in range(24) for j in range(24)], "grp string, q long, p long, sim double")
    got = A.one_to_one(pairs, "grp").collect()
    assert len({r.q for r in got}) == len({r.p for r in got}) == 24
    # the dual bound: no assignment's total is above the sum of profits and prices, found by a plain auction
    price, held = np.zeros(24), {}
    free = list(range(24))
    while free:
        i = free.pop(0)
        net = sims[i] - price
        j = int(net.argmax())
        second = np.delete(net, j).max()
        price[j] += net[j] - second + 1e-8
        if j in held:
            free.append(held[j])
        held[j] = i
    bound = price.sum() + (sims - price).max(axis=1).sum()
    assert sum(r.sim for r in got) == pytest.approx(bound, abs=2e-6)


@pytest.mark.parametrize(("bidders", "mind"), [(1 << 15, 128), (7, 3)])
def test_vectors_are_matched_without_rows_of_pairs(spark, monkeypatch, bidders, mind):
    """The same totals as over pairs; no table that is written has as many rows as there are pairs."""
    import numpy as np

    from askloom.operators import retrieval as R
    from askloom.storage import Rounds

    monkeypatch.setattr(A, "BIDDERS", bidders)
    monkeypatch.setattr(A, "MIND", mind)
    rng, written, put = np.random.default_rng(2), [], Rounds.put
    made = lambda ids, g: [(g, int(i), rng.normal(size=4).tolist()) for i in ids]
    kind = "g string, id long, vec array<double>"
    left = spark.createDataFrame([*made(range(20), "a"), *made([3, 3], "a"), *made(range(50, 75), "b"), *made([90], None), *made([91], "c"), ("a", 20, None)], kind)
    right = spark.createDataFrame([*made(range(100, 126), "a"), *made([101], "a"), *made(range(150, 162), "b"), *made([190], None), *made([192], "d")], kind)
    want = A.one_to_one(R.dense_top_k(left, right, None, "g"), "g").collect()

    def counted(self, name, df):
        out = put(self, name, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Rounds, "put", counted)
    got = A.one_to_one_vectors(left, right, "g").collect()
    sims = {(r.q, r.p): r.sim for r in R.dense_top_k(left, right, None, "g").groupBy("q", "p").agg({"sim": "max"}).toDF("q", "p", "sim").collect()}
    assert len({r.q for r in got}) == len({r.p for r in got}) == len(got) == len(want) == 33
    assert all(sims[r.q, r.p] == pytest.approx(r.sim, abs=1e-9) for r in got)
    assert sum(r.sim for r in got) == pytest.approx(sum(r.sim for r in want), abs=2e-5)
    assert max(written) <= left.count() + right.count()
    assert A.one_to_one_vectors(left.where("false"), right, "g").count() == 0
