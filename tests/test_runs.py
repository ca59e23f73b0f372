"""Run folders: commits, artifacts, sidecars, candidates, notes and states."""

from __future__ import annotations

import gzip
import json

import pytest

from askloom.sources import runs as S


def test_store(tmp_path):
    store = S.Store(str(tmp_path / "store"))
    assert store.names() == [] and store.json("x.json", {}) == {}
    assert store.commit("r1", {"a.txt": b"1", "b/c.txt": b"2"}) == []
    assert store.commit("r1", {"a.txt": b"3"}) == ["r1/b/c.txt"] and store.names("r1") == ["r1/a.txt"] and store.read("r1/a.txt") == b"3"
    local = S.artifact(store, "run:r1", str(tmp_path / "local"))
    store.write("r1/a.txt", b"4")
    assert open(f"{local}/a.txt", "rb").read() == b"3" and S.artifact(store, "run:r1", str(tmp_path / "local")) == local
    assert S.artifact(store, "/some/path", "x") == "/some/path"
    with pytest.raises(FileNotFoundError):
        S.artifact(store, "run:none", str(tmp_path / "local"))


def test_records_and_notes(tmp_path):
    store = S.Store(f"file://{tmp_path}")
    assert S.record(store, "r", {"status": "ok"}, [str(i) for i in range(500)])["log_lines"] == 300
    assert store.json("r/result.json") == {"status": "ok"} and store.read("r/log.txt").decode().splitlines()[0] == "200"
    assert S.note(store, "EXP-1", "text") and not S.note(store, "EXP-1", "new") and S.note(store, "EXP-2", "x")
    assert store.read("index.md").decode() == "- [[EXP-1]]\n- [[EXP-2]]\n" and store.read("EXP-1.md") == b"new"


def test_folders_and_stubs(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "Train.csv").write_text("x")
    assert S.locate([str(tmp_path / "a"), str(tmp_path / "b")], ["Train.csv"]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        S.locate([str(tmp_path)], ["Train.csv"])
    with pytest.raises(NotImplementedError):
        S.stub("corpus")(None)


def test_sidecars_and_candidates(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    for name, text in (("a", '{"score": "0.5", "name": "x"}'), ("b", '{"score": "none", "other": 1}'), ("c", "no json"), ("d", "[1]")):
        (tmp_path / "meta" / f"{name}.json").write_text(text)
    got = {r.file: (r.score, r["name"]) for r in S.sidecars(spark, str(tmp_path / "meta"), {"score": "double", "name": "string"}).collect()}
    assert got == {"a.json": (0.5, "x"), "b.json": (None, None)}
    run = tmp_path / "run"
    run.mkdir()
    (run / "test_preds.csv").write_text('ID,pred,cand_ids\n1,"two\nlines",a|b||c\n2,x,\n')
    with gzip.open(run / "oof_lists.csv.gz", "wt") as file:
        file.write("ID,cand_ids\n3,d\n")
    assert {r.ID: r.candidates for r in S.run_candidates(spark, str(run)).collect()} == {"1": ["a", "b", "c"], "2": None, "3": ["d"]}
    with pytest.raises(FileNotFoundError):
        S.run_candidates(spark, str(tmp_path / "meta"))


def test_splits_scores_and_states(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "id long, split string")
    S.save_splits(rows, str(tmp_path / "splits"))
    S.save_splits(rows.where("split = 'val'").withColumn("id", rows.id + 10), str(tmp_path / "splits"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "splits")).select("id", "split").collect()} == {(1, "train"), (12, "val")}
    S.save_scores(rows.groupBy("split").count(), rows, str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores/report")).count() == 2
    specs = spark.createDataFrame([(x,) for x in "abcde"], "run string")
    claims = spark.createDataFrame([("b", 10), ("c", 5000), ("c", 4000)], "run string, age long")
    results = spark.createDataFrame([("a", "crash"), ("a", "ok"), ("d", "crash")], "run string, status string")
    assert {r.run: r.state for r in S.status_report(specs, claims, results).collect()} == {"a": "done", "b": "running", "c": "stale", "d": "failed", "e": "queued"}
    assert json.loads("{}") == {}
