"""Runs by mode, resumed and virtual runs, scores, the log and what it adopts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from askloom.operators import experiments as E


@pytest.fixture(scope="module")
def pool(spark):
    rows = [("a1", "x", "red apple tree", "apples are red"), ("a2", "x", "red apple pie", "bake it"), ("a3", "x", "green pear tree", "bake it"), ("a4", "x", "blue sea", "salt"), ("b1", "y", "red apple tree", "other subset"), ("b2", "y", "lonely words", "nothing"), ("c1", "z", None, "no text")]
    return spark.createDataFrame(rows, "id string, subset string, input string, output string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "x", "red apple tree house"), ("a1", "x", "red apple tree"), ("q2", "x", "unknown"), ("q3", "w", "red apple"), ("q4", "x", None)], "id string, subset string, input string")


def test_modes(asked, pool):
    loud = lambda: lambda prompts: [p.upper() for p in prompts]
    got = {r.id: r for r in E.run({}, asked, pool).collect()}
    assert {i: r.answer for i, r in got.items()} == {"q1": "apples are red", "a1": "bake it", "q2": "", "q3": "", "q4": ""}
    assert got["a1"].nn == "a2" and got["q1"].nn == "a1" and got["q2"].sim is None
    voted = {r.id: r.answer for r in E.run({"select": "vote", "vote_power": 0.1}, asked, pool).collect()}
    assert voted["q1"] == "bake it"  # two rows of it outvote the nearest
    routed = {r.id: (r.route, r.answer) for r in E.run({"mode": "router", "threshold": 0.7, "examples": 1}, asked, pool, loud).collect()}
    assert routed["q1"] == ("copy", "apples are red") and routed["q2"] == ("generate", "Q: UNKNOWN\nA:")
    assert routed["a1"][0] == "generate" and routed["a1"][1].startswith("Q: RED APPLE PIE\nA: BAKE IT\n\nQ: RED APPLE TREE\nA:")
    rag = {r.id: r.answer for r in E.run({"mode": "rag", "examples": 2}, asked, pool, loud).collect()}
    assert rag["q1"].index("RED APPLE PIE") < rag["q1"].index("Q: RED APPLE TREE\nA: APPLES")  # the nearest last
    for bad in ({"mod": 1}, {"mode": "magic"}, {"select": "worst"}, {"words": "none"}):
        with pytest.raises(ValueError):
            E.run(bad, asked, pool)
    with pytest.raises(ValueError):
        E.run({"mode": "rag"}, asked, pool)
    assert E.run({}, asked.where("false"), pool).count() == 0 and E.run({}, asked, pool.where("false")).count() == 5


def test_resumed_and_virtual(spark, asked, pool):
    old = spark.createDataFrame([("q1", "kept"), ("gone", "x")], "id string, answer string")
    got = {r.id: (r.answer, r.route) for r in E.run({}, asked, pool, resume=old).collect()}
    assert got["q1"] == ("kept", "resumed") and got["a1"] == ("bake it", "copy") and len(got) == 5
    sel = spark.createDataFrame([("q1", "s", ["s", "t"]), ("q2", "", ["t"]), ("q3", "s", ["s", "u", "t"])], "id string, answer string, answers array<string>")
    gen = spark.createDataFrame([("q1", " t "), ("q2", "g"), ("q3", "t")], "id string, answer string")
    assert {r.id: (r.answer, r.route) for r in E.virtual("agree", sel, gen, k=2).collect()} == {"q1": ("t", "gen"), "q2": ("", "sel"), "q3": ("s", "sel")}
    assert {r.id: (r.answer, r.route) for r in E.virtual("fill", sel, gen).collect()} == {"q1": ("s", "sel"), "q2": ("g", "gen"), "q3": ("s", "sel")}
    with pytest.raises(ValueError):
        E.virtual("other", sel, gen)


def test_scores_log_and_adoption(spark, pool):
    answers = spark.createDataFrame([("a1", "apples are green"), ("a2", "bake it"), ("b1", None)], "id string, answer string")
    report = E.scores(answers, pool.where("subset in ('x', 'y')"))
    got = {r.subset: r for r in report.collect()}
    assert got["x"].n == 4 and got["x"].rouge1 == pytest.approx((2 / 3 + 1) / 4, abs=1e-6) and got["y"].rouge1 == 0
    assert got["ALL"].rouge1 == pytest.approx((2 / 3 + 1) / 6, abs=1e-6)
    log = E.record("r1", {"mode": "retrieval"}, report, 1).unionByName(E.record("r2", {"k": 3}, report.withColumn("rouge_only", F.col("rouge_only") + F.when(F.col("subset") == "y", 0.002).otherwise(0.5)), 2))
    assert {json.loads(r.config).get("mode") for r in log.collect()} == {"retrieval", None}
    best = spark.createDataFrame([("y", "r0", 0.0), ("w", "r0", 0.3)], "subset string, run string, rouge_only double")
    won = {r.subset: (r.run, r.won) for r in E.adopted(log, best).collect()}
    assert won == {"x": ("r2", True), "y": ("r0", False), "w": ("r0", False)}
    assert {r.subset for r in E.adopted(log, best.where("false")).collect()} == {"x", "y"}
