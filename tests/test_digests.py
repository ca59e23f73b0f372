"""Fingerprints and digest trees: repeats, nulls, order, and the ranges that changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import frames as D
from askloom.operators import validation as V

KIND = "id long, a string, b string"


def test_fingerprints_keep_repeats_and_nulls(spark):
    make = lambda rows: spark.createDataFrame(rows, KIND)
    base = [(1, "x", "y"), (2, None, "a"), (3, "", None)]
    same = lambda rows: D.same_hash(make(base), make(rows), ["id", "a", "b"]).first()["equal"]
    assert same(base[::-1])
    assert not same(base + base[:1] * 2) and not same(base + base[:1]) and not same(base[:2])
    assert not same([base[0], (2, "a", None), base[2]]) and not same([*base[:2], (3, None, "")])
    assert not D.same_hash(make([(1, "a,1:b", "c")]), make([(1, "a", "b,1:c")]), ["a", "b"]).first()["equal"]
    assert D.same_hash(make([]), make([]), ["id"]).first()["equal"]


def test_digest_tree_finds_changed_ranges(spark):
    rows = [(i, f"t{i}", None if i % 7 == 0 else "z") for i in range(200)] + [(5, "t5", "z"), (None, "n", None)]
    df = spark.createDataFrame(rows, KIND)
    tree = lambda x: V.digest_tree(x, "id", ["id", "a", "b"], 8, 2)
    assert V.differing_ranges(tree(df), tree(df.repartition(5).orderBy(F.rand(3)))).count() == 0
    moved = df.withColumn("a", F.when(F.col("id").isin(17, 18, 150), "other").otherwise(F.col("a")))
    assert {tuple(r) for r in V.differing_ranges(tree(df), tree(moved)).collect()} == {(0, 0), (1, 2), (1, 18), (2, 0), (2, 2)}
    more = df.unionByName(df.where("id = 100"))
    assert {tuple(r) for r in V.differing_ranges(tree(df), tree(more)).collect()} == {(0, 0), (1, 12), (2, 1)}
    assert tree(df.where("false")).where("level = 1").count() == 0
