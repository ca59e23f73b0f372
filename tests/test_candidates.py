"""Queries of choosing among candidates against their SQL, and ties to the digits that the SQL orders by."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import duckdb
import pytest
import __spark_entry__ as entry
from askloom.operators import ranking as K
from askloom.operators import selection as S


def test_runs_leave_out_questions_without_a_neighbour(spark, tmp_path):
    texts = ["one two three", "two three four", "only here", "one four", "", "four five one"]
    rows = []
    for i, t in enumerate(texts):
        rows += [(4 * i, 0, "user", t), (4 * i, 1, "assistant", f"answer {t} of {i}")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in entry.queries()["run_modes"](spark, str(tmp_path)).select("mode", "subset", "n", "rouge1").collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = set(db.execute(entry.oracle_sql()["run_modes"]).fetchall())
    assert got == want and {n for _, _, n, _ in got} == {4}


def test_ties_stand_to_the_digits_asked_for(spark):
    rows = [("q", 0, 1, 0.3000001), ("q", 1, 0, 0.3000002), ("q", 2, 0, 0.1)]
    df = spark.createDataFrame(rows, "q string, i long, j long, overlap double")
    assert S.medoid(df).first().i == 1
    assert tuple(S.medoid(df, digits=6).first()) == ("q", 0, 0.3)
    near = spark.createDataFrame([("q", "b", 0.5, 1), ("q", "a", 0.50000001, 1), ("q", "c", 0.50000002, 2)], "q string, answer string, sim double, rank int")
    assert S.vote(near, 1.0).first().answer == "c"
    assert S.vote(near, 1.0, 6).first().answer == "a"


def test_dots_of_pairs_by_terms_and_by_vectors(spark, monkeypatch):
    import pyarrow as pa

    lists = [pa.array(x) for x in ([[1, 2, 3], None, [], [7]], [[1.0, 2.0, 3.0], None, [], [0.5]], [[3, 1, 9], [1], [2], [7]], [[2.0, 4.0, 1.0], [1.0], [1.0], [0.5]])]
    for some in (1 << 20, 2):
        monkeypatch.setattr(K, "DOTS", some)
        assert K._dots(*lists).to_pylist() == [10.0, 0.0, 0.0, 0.25]
    w = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.8), ("b", "y", 0.5)], "id string, term string, w double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "none")], "q string, p string")
    assert {(r.q, r.p, round(r.sim, 9)) for r in K.pair_dots(pairs, w, w).collect()} == {("a", "b", 0.4), ("a", "none", 0.0)}


@pytest.mark.parametrize("name", ["fold_fusion", "mbr_medoid"])
def test_both_lists_are_ranked_once(spark, monkeypatch, name):
    """What chooses among the lists reads them from files: none of its branches ranks them again."""
    from askloom.plans import candidate_queries as C

    with redirect_stdout(io.StringIO()) as said:
        C.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    assert "FlatMapCoGroups" not in said.getvalue()
