"""Echo features of candidates and lint of links, by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import ranking as K
from askloom.operators import reports as T


def test_echo_features(spark):
    pool = [("p1", "s", "a b c d e"), ("p2", "s", "a b c d e"), ("p3", "s", "a b c d f"), ("p4", "s", "x y"), ("p5", "t", "a b c d e"), ("q1", "s", "own")]
    df = spark.createDataFrame(pool, "id string, subset string, output string")
    rows = spark.createDataFrame([("q1", t) for t in ("a b c d e", "a b c d f", "x y")] + [("p4", "own")], "q string, answer string")
    got = {(r.q, r.answer): tuple(r)[2:] for r in K.echo_features(rows, df, X.words_plain(F.col("t"))).collect()}
    assert got == {
        ("q1", "a b c d e"): (pytest.approx(math.log(3), abs=1e-6), 0.4, 0.8, 1),
        ("q1", "a b c d f"): (pytest.approx(math.log(3), abs=1e-6), 0.4, 0.8, 1),
        ("q1", "x y"): (0.0, 0.0, 0.0, 0),
        ("p4", "own"): (0.0, 0.0, 0.0, 0),
    }


def test_link_lint(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone"), ("c", "c"), ("b", None), ("b", "a")], "source string, target string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "name string")
    dead, orphans = T.link_lint(links, names)
    assert [tuple(r) for r in dead.collect()] == [("a", "gone")] and [r.name for r in orphans.collect()] == ["c"]
