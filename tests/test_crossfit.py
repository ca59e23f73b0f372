"""Cross-fitted lists against brute force; tolerance of splits; submissions with marks and wrong columns."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import crossfit as C
from askloom.operators import ranking as K
from askloom.operators import validation as V
from askloom.sources import readers


def test_cross_fitted_lists(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(2, 7)))
    pool = [(f"p{i}", "st"[i % 2], text()) for i in range(30)] + [("p98", "s", None), ("p99", "lone", "aa bb")]
    asked = [(f"e{i}", "st"[i % 2], text()) for i in range(6)] + [("e9", "s", None)]
    kind = "id string, subset string, input string"
    df = spark.createDataFrame(pool, kind)
    train, per_fold = C.cross_fitted(df, spark.createDataFrame(asked, kind), X.words, 3, 4)
    fold = {r.id: r.f for r in df.select("id", K.question_fold(F.col("id"), 3).alias("f")).collect()}

    def vectors(f):
        fit = [t.split() for i, _, t in pool if fold[i] != f and t]
        n = sum(fold[i] != f for i, _, _ in pool)
        idf = {w: math.log((1 + n) / (1 + sum(w in d for d in fit))) + 1 for d in fit for w in d}
        out = {}
        for i, s, t in [*pool, *asked]:
            raw = {w: (1 + math.log(t.split().count(w))) * idf[w] for w in set((t or "").split()) if w in idf}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            out[i] = (s, {w: x / norm for w, x in raw.items()})
        return out

    def best(held, q, k):
        s, v = held[q]
        sims = {p: round(sum(x * held[p][1].get(w, 0.0) for w, x in v.items()), 6) for p, g, _ in pool if g == s and p != q}
        return [(p, sims[p]) for p in sorted(sims, key=lambda p: (-sims[p], p)) if sims[p] > 0][:k]

    by = lambda rows: {key: [(r.p, pytest.approx(r.sim, abs=2e-6)) for r in sorted(rows, key=lambda r: r["rank"]) if (r.fold, r.q) == key] for key in {(r.fold, r.q) for r in rows}}
    want_train, want_eval = {}, {}
    for f in range(3):
        held = vectors(f)
        want_train |= {(f, i): best(held, i, 4) for i, _, _ in pool if fold[i] == f and best(held, i, 4)}
        want_eval |= {(f, i): best(held, i, 4) for i, _, _ in asked if best(held, i, 4)}
    assert by(train.collect()) == want_train and by(per_fold.collect()) == want_eval
    for q in {q for _, q in want_eval}:
        lists = {f: dict(x) for (f, i), x in want_eval.items() if i == q}
        mean = {p: sum(x.get(p, min(x.values())) for x in lists.values()) / len(lists) for x in lists.values() for p in x}
        top = C.fused(per_fold, 3).where(F.col("q") == q).orderBy("rank").collect()
        assert [round(r.score, 5) for r in top] == [round(x, 5) for x in sorted(mean.values(), reverse=True)[:3]]
    assert C.joined(train.limit(0), ["fold", "q"]).count() == 0


def test_tolerance(spark):
    rows = [("a", 80, 10, 10), ("b", 79, 11, 10), ("c", 50, 25, 25), ("d", 1, None, None), ("e", 0, 0, 0)]
    df = spark.createDataFrame(rows, "g string, train int, val int, test int")
    got = {r.g: (r.ok, r.train_share) for r in V.within_tolerance(df, "g", {"train": 0.8, "val": 0.1, "test": 0.1}, 0.01).collect()}
    assert got == {"a": (True, 0.8), "b": (True, 0.79), "c": (False, 0.5), "d": (False, 1.0), "e": (False, 0.0)}


def test_submission_files(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("ID,a,b\n1,x,NA\n")
    assert [tuple(r) for r in readers.submission(spark, str(good), ["ID", "a", "b"]).collect()] == [("1", "x", "")]
    for name, data in (("bom.csv", b"\xef\xbb\xbfID,a,b\n1,x,y\n"), ("order.csv", b"ID,b,a\n1,x,y\n"), ("more.csv", b"ID,a,b,c\n1,x,y,z\n")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            readers.submission(spark, str(tmp_path / name), ["ID", "a", "b"])
    with pytest.raises(FileNotFoundError):
        readers.submission(spark, str(tmp_path / "none.csv"), ["ID"])


def test_lists_that_nobody_reads_are_not_prepared(spark, monkeypatch):
    from askloom import storage

    put, written = storage.Rounds.put, []
    monkeypatch.setattr(storage.Rounds, "put", lambda self, name, df: written.append(name) or put(self, name, df))
    kind = "id string, subset string, input string"
    df = spark.createDataFrame([(f"p{i}", "s", f"a{i % 3} b{i % 4}") for i in range(12)], kind)
    _, per_fold = C.cross_fitted(df, spark.createDataFrame([("e", "s", "a1 b2")], kind), X.words, 2, 2)
    assert per_fold.count() == 4
    assert sorted(written) == ["counts", "vectors"]
