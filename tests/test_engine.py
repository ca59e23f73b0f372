"""Blocked joins against brute force, hooks, frames and reports on hand-computed cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import prompts as P
from askloom.functions import text as X
from askloom.operators import blocks as B
from askloom.operators import frames as D
from askloom.operators import hooks as H
from askloom.operators import reports as T
from askloom.operators import retrieval as R


def test_blocks_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, "a", [0.0] * 4), (61, "a", None), (62, "c", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, g string, vec array<double>")
    queries, pool = df.where("id % 3 = 0 or id > 59"), df.where("id % 3 <> 0 and id < 60")

    def unit(v):
        n = math.sqrt(sum(x * x for x in v or [0.0] * 4))
        return [x / n if n else 0.0 for x in v or [0.0] * 4]

    for whole in (False, True):
        want = set()
        for q, g, v in rows:
            if not (q % 3 == 0 or q > 59):
                continue
            own = [(i, w) for i, h, w in rows if i % 3 and i < 60 and h == g and (whole or g is not None)]
            if whole and not own:
                own = [(i, w) for i, h, w in rows if i % 3 and i < 60]
            best = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w), strict=True)), 6), i) for i, w in own)[:3]
            want |= {(q, p, -s + 0.0, n + 1) for n, (s, p) in enumerate(best)}
        for size in (4096, 7):
            found = B.in_blocks(queries, pool, "g", B.dense_scores, size, 3, whole_pool=whole)
            got = {(r.q, r.p, r.sim + 0.0, r.n) for r in R.top_k(found, 3, ["q"], [F.desc("sim"), F.asc("p")]).withColumnRenamed("rank", "n").collect()}
            assert {(q, p, n) for q, p, _, n in got} == {(q, p, n) for q, p, _, n in want}
    assert B.in_blocks(queries.where("false"), pool, "g", B.dense_scores, 8, 3).count() == 0


def test_sparse_joins_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    texts = {i: [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 9))] for i in range(50)}
    texts |= {i + 100: [*texts[i], "z"] for i in range(10)}
    rows = []
    for i, words in texts.items():
        norm = math.sqrt(sum(words.count(w) ** 2 for w in set(words)))
        rows += [(i, "s", w, words.count(w) / norm) for w in sorted(set(words))]
    df = spark.createDataFrame(rows, "id long, g string, term string, w double")
    vectors = {i: {t: w for k, _, t, w in rows if k == i} for i in texts}
    dot = lambda a, b: sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
    near = {(a, b) for a in texts for b in texts if round(dot(a, b), 9) >= 0.8}
    assert {(r.q, r.p) for r in R.sparse_at_least(df.select("id", "term", "w"), 0.8).collect()} == near
    monkeypatch.setattr(B, "SPARSE_ROWS", 11)
    monkeypatch.setattr(B, "PRODUCTS", 20)
    monkeypatch.setattr(B, "CELLS", 60)
    got = {(r.q, r["rank"]): r.p for r in R.sparse_top_k(df, df, 2, "g", drop_self=True).collect()}
    for a in texts:
        best = sorted((-round(dot(a, b), 6), b) for b in texts if b != a and dot(a, b) > 0)[:2]
        assert [got.get((a, n + 1)) for n in range(len(best))] == [b for _, b in best]


def test_bounds_rule_out_pairs_and_keep_the_best():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    chance = 1 / np.arange(1, 2001) ** 0.9
    chance /= chance.sum()
    lists = [np.unique(rng.choice(2000, 60, p=chance)) for _ in range(300)]
    lists += [np.unique(np.concatenate((x[: len(x) * 9 // 10], rng.choice(2000, 5)))) for x in lists[:150]] + [np.array([], int)]
    weights = [rng.random(len(x)) / np.log2(2 + 1 / chance[x].clip(1e-9)) + np.log(1 / chance[x]) if len(x) else x.astype(float) for x in lists]
    weights = [w / np.linalg.norm(w) if len(w) else w for w in weights]
    side = pa.table({"id": list(range(len(lists))), "terms": [x.tolist() for x in lists], "w": [w.tolist() for w in weights]})
    wide = np.zeros((len(lists), 2000))
    for row, x, w in zip(wide, lists, weights, strict=True):
        row[x] = w
    sims = np.round(wide @ wide.T, 6)
    np.fill_diagonal(sims, 0.0)
    i, j, found, scored = B.sparse_best(side, side, 2, "id", 6)
    want = {(a, b): sims[a, b] for a in range(len(lists)) for b in sorted(range(len(lists)), key=lambda b: (-sims[a, b], b))[:2] if sims[a, b] > 0}
    got = dict(zip(zip(i.tolist(), j.tolist(), strict=True), found.tolist(), strict=True))
    assert got == pytest.approx(want, abs=2e-6) and scored < len(lists) ** 2 / 10
    with pytest.raises(ValueError):
        B.sparse_best(pa.table({"id": [1], "terms": [[1]], "w": [[-1.0]]}), side, 2, None, 6)


def test_hooks_check_lengths():
    calls = []

    def backend(texts):
        calls.append(len(texts))
        return [t.upper() for t in texts]

    assert H.checked(backend, list("abcde"), batch=2) == list("ABCDE") and calls == [2, 2, 1]
    with pytest.raises(ValueError):
        H.checked(lambda texts: texts[:-1], ["a", "b"])


def test_translation_is_memoised(spark):
    rows = spark.createDataFrame([(1, "x", "a", "b"), (2, "x", "a", "b"), (3, "y", "b", "b"), (4, None, "a", "b"), (5, "z", None, "b")], "id long, t string, s string, g string")
    got = {r.id: r.translated for r in H.translate(rows, "t", "s", "g", H.tagging_translator).collect()}
    assert got == {1: "[a>b] x", 2: "[a>b] x", 3: "y", 4: None, 5: "z"}


def test_retry_and_echo(spark):
    rows = spark.createDataFrame([(1, "odd", "w odd", "q1"), (2, "even", "w even", "q2"), (3, "ab", "abc", "q3"), (4, None, "ab", "q4")], "id long, p string, strong string, question string")
    got = {r.id: (r.text, r.attempt) for r in H.with_retry(rows, "p", "strong", "question", H.shy_generator, X.is_refusal).collect()}
    assert got == {1: ("answer to 3", 1), 2: ("q2", 3), 3: ("answer to 3", 2), 4: ("q4", 3)}


def test_roles():
    assert D.detect_roles(["ID", "input", "output", "subset"], ["ID", "input", "output", "subset"], ["ID", "input", "subset"]) == {"id": "ID", "question": "input", "answer": "output", "language": "subset"}
    assert D.detect_roles(["row_id", "prompt", "target", "where"], ["row_id", "prompt", "target", "where"], ["row_id", "prompt", "where"])["language"] == "where"
    for bad in (["input", "output"], ["id", "output"], ["id", "input", "x"]):
        with pytest.raises(ValueError):
            D.detect_roles(bad, bad, [c for c in bad if c != "output"])


def test_errors_end_the_job(spark):
    left = spark.createDataFrame([(1,), (2,)], "id long")
    right = spark.createDataFrame([(1, "x")], "id long, v string")
    assert D.left_required(left.where("id = 1"), right, "id", ["v"]).first()["v"] == "x"
    for bad in (D.left_required(left, right, "id", ["v"]), spark.createDataFrame([("Klingon",)], "l string").select(D.known_language(F.col("l"))), D.required(spark.createDataFrame([("s", None)], "subset string, run string"))):
        with pytest.raises(Exception):  # noqa: B017
            bad.collect()
    with pytest.raises(ValueError):
        T.refuse_closed("openrouter/gpt-9")
    assert T.refuse_closed("local/open-model") == "local/open-model"


def test_composites_and_pins(spark):
    champions = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", "r3")], "subset string, run string")
    preds = spark.createDataFrame([("r1", "a"), ("k1", "b"), ("k2", "b"), ("r9", "c")], "run string, subset string")
    kids = spark.createDataFrame([("r2", "k1", 1), ("r2", "k2", 2), ("r2", "k3", 3)], "parent string, run string, finished long")
    assert {r.subset: r.run for r in D.composite(champions, preds, kids).collect()} == {"a": "r1", "b": "k2", "c": None}
    use = spark.createDataFrame([("c", "r9")], "subset string, run string")
    assert {r.subset: r.run for r in D.composite(champions, preds, kids, use).collect()}["c"] == "r9"
    mark = D.same_hash(preds, preds.orderBy("subset"), preds.columns).first()
    assert mark["equal"] and D.pinned(preds, preds.columns, mark["left"]) is preds
    with pytest.raises(ValueError):
        D.pinned(preds.limit(1), preds.columns, mark["left"])
    assert D.slug({"b": 1, "a": "x/y"}) == "a-x-y_b-1" and D.slug({}) == "default"


def test_report_total_and_gap(spark):
    rows = spark.createDataFrame([("x", 0.5, 0.25, 1.0), ("x", 0.5, 0.75, None), ("y", 1.0, 1.0, None)], "g string, r1 double, rl double, judge double")
    got = {r.g: r for r in T.full_report(rows, "g", "judge").collect()}
    assert got["x"].judge_n == 1 and got["x"].total == pytest.approx(0.37 * 0.5 + 0.37 * 0.5 + 0.26) and got["y"].total is None and got["ALL"].n == 3
    assert T.gap(T.full_report(rows, "g", "judge"), "g", "rouge1").first()["gap"] == 0.5


def test_sentences_and_messages(spark):
    df = spark.createDataFrame([("One. Two!", "Eins. Zwei!", "a. b\n\nc"), ("One. Two!", "Alles", "")], "a string, b string, c string")
    got = df.select(T.sentence_pairs(F.col("a"), F.col("b")).alias("x"), T.by_sentence(F.col("c"), F.upper).alias("y"), P.render(P.messages(F.col("a"), F.col("b"))).alias("m")).collect()
    assert [tuple(x) for x in got[0].x] == [("One.", "Eins."), ("Two!", "Zwei!"), ("Eins.", "One."), ("Zwei!", "Two!")]
    assert [tuple(x) for x in got[1].x] == [("One. Two!", "Alles"), ("Alles", "One. Two!")] and [r.y for r in got] == ["A. B\n\nC", ""]
    assert got[0].m == "One. Two!\n\nEins. Zwei!"
    with pytest.raises(ValueError):
        P.fill("{x}", y=F.lit(1))


def test_pooling_and_loops(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [True, True, False], "go " * 3000), ([[1.0, 2.0]], [False], "a a a a a a a a a b")], "v array<array<double>>, m array<boolean>, t string")
    got = df.select(M.mean_pool(F.col("v"), F.col("m")).alias("p"), X.has_loop(F.col("t")).alias("loop")).collect()
    assert [r.p for r in got] == [[2.0, 3.0], [0.0, 0.0]] and [r.loop for r in got] == [True, False]
