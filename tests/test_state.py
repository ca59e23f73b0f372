"""Streams with state, timers, byte offsets and batch commits, each across restarts."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from askloom.streaming import resume, state, tail


def run_until(make, out, check, done, seconds=120):
    """Runs the stream in append mode until done(rows) or the time is up."""
    query = make.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + seconds
        while time.time() < end:
            if query.exception():
                raise query.exception()
            rows = make.sparkSession.read.schema(make.schema).parquet(out).collect() if os.path.isdir(out) else []
            if done(rows):
                return rows
            time.sleep(1)
        raise AssertionError(f"not there in time: {rows}")
    finally:
        query.stop()


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    os.rename(folder / f".{name}", folder / name)


@pytest.fixture
def store(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield state.with_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_leases_expire_by_timer(store, tmp_path):
    events = tmp_path / "in"
    put(events, "a.json", [{"spec": "r1", "session": "s1", "kind": "claim", "at": 1}, {"spec": "r1", "session": "s2", "kind": "claim", "at": 2}, {"spec": "r2", "session": "s1", "kind": "claim", "at": 1}, {"spec": None, "session": "s1", "kind": "claim", "at": 1}])
    stream = store.readStream.schema("spec string, session string, kind string, at long").json(str(events))
    make = state.leases(stream, stale_seconds=20)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    first = run_until(make, out, check, lambda rows: len(rows) >= 3)
    assert {(r.spec, r.session, r.event) for r in first} == {("r1", "s1", "granted"), ("r1", "s2", "refused"), ("r2", "s1", "granted")}
    put(events, "b.json", [{"spec": "r2", "session": "s1", "kind": "done", "at": 3}])
    rows = run_until(make, out, check, lambda rows: any(r.event == "expired" for r in rows))  # another start, same state
    assert {(r.spec, r.session, r.event) for r in rows} - {(r.spec, r.session, r.event) for r in first} == {("r2", "s1", "released"), ("r1", "s1", "expired")}
    granted = {r.spec: r.at for r in rows if r.event == "granted"}
    assert all(r.at >= granted["r1"] + 20_000 for r in rows if r.event == "expired")
    put(events, "c.json", [{"spec": "r1", "session": "s2", "kind": "claim", "at": 4}, {"spec": "r1", "session": "s2", "kind": "beat", "at": 5}, {"spec": "r1", "session": "s1", "kind": "beat", "at": 6}])
    rows = run_until(make, out, check, lambda rows: len(rows) >= 8)
    assert [(r.session, r.event) for r in sorted(rows, key=lambda r: r.at) if r.spec == "r1"][3:] == [("s2", "granted"), ("s2", "renewed"), ("s1", "refused")]


def test_groups_are_emitted_once(store, tmp_path):
    part = lambda g, p, n=3: {"grp": g, "part": p, "value": f"{g}{p}", "n": n}
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(folder, "a.json", [part("a", 0), part("a", 2), part("a", 2), part("b", 1, 1), {"grp": None, "part": 1, "value": "x", "n": 1}])
    make = state.complete_once(store.readStream.schema("grp string, part int, value string, n int").json(str(folder)))
    assert [tuple(r) for r in run_until(make, out, check, lambda rows: rows)] == [("b", 1, [1], ["b1"])]
    put(folder, "b.json", [part("a", 1), part("b", 1, 1)])
    put(folder, "c.json", [part("a", 1), part("a", 0), part("c", 0, 1)])
    rows = run_until(make, out, check, lambda rows: len(rows) >= 3)
    put(folder, "d.json", [part("a", 2), part("d", 0, 1)])
    rows = run_until(make, out, check, lambda rows: any(r.grp == "d" for r in rows))
    assert sorted(tuple(r) for r in rows) == [("a", 3, [0, 1, 2], ["a0", "a1", "a2"]), ("b", 1, [1], ["b1"]), ("c", 1, [0], ["c0"]), ("d", 1, [0], ["d0"])]


def test_appended_lines_come_once(spark, tmp_path, monkeypatch):
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    os.makedirs(folder)
    log = folder / "worker.jsonl"

    def lines():
        stream = tail.appended_lines(spark, str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((os.path.basename(r.file), r.at, r.line) for r in spark.read.parquet(out).collect())

    log.write_bytes(b'{"id": 1}\n\n{"id": 2}\r\n{"id"')
    assert [x[2] for x in lines()] == ['{"id": 1}', '{"id": 2}']
    with log.open("ab") as f:
        f.write(b": 3}\n" + "é\n".encode())
    (folder / "other.jsonl").write_bytes(b"x\n")
    (folder / "other.txt").write_bytes(b"not read\n")
    assert lines() == [("other.jsonl", 0, "x"), ("worker.jsonl", 0, '{"id": 1}'), ("worker.jsonl", 11, '{"id": 2}'), ("worker.jsonl", 22, '{"id": 3}'), ("worker.jsonl", 32, "é")]
    assert len(lines()) == 5
    log.write_bytes(b"new\n")  # written anew
    assert [x[2] for x in lines() if x[0] == "worker.jsonl" and x[1] == 0] == ["new", '{"id": 1}']


def test_ranges_share_no_line(tmp_path, monkeypatch):
    import random

    rng = random.Random(1)
    text = [("é" * rng.randrange(0, 9) + str(i)).encode() for i in range(200)]
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(text) + b"\nunfinished")
    reader = tail.TailReader({"path": str(tmp_path)})
    for size, block in ((1, 2), (7, 3), (64, 1 << 16)):
        monkeypatch.setattr(tail, "RANGE_BYTES", size)
        monkeypatch.setattr(tail, "BLOCK", block)
        got = [x for part in reader.partitions({}, reader.latestOffset()) for x in reader.read(part)]
        assert [x[2].encode() for x in got] == text
    half = got[100][1]
    path = got[0][0]
    assert [x[2].encode() for part in reader.partitions({path: half}, reader.latestOffset()) for x in reader.read(part)] == text[100:]


def test_killed_runs_answer_each_row_once(spark, tmp_path):
    queue, folder = tmp_path / "queue", str(tmp_path / "run")
    for k in range(4):
        put(queue, f"{k}.json", [{"id": 10 * k + i} for i in range(3)])
        os.utime(queue / f"{k}.json", (1000 + k, 1000 + k))
    pending = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(queue))
    worked = []

    def work(batch):
        ids = sorted(r.id for r in batch.collect())
        worked.append(ids)
        if len(worked) == 3:
            batch.select((F.col("id") * 2).alias("id"), F.lit("half").alias("answer"), F.lit(2).cast("long").alias("batch")).write.mode("append").partitionBy("batch").parquet(f"{folder}/answers")
            raise RuntimeError("killed")  # after it left some rows of its batch
        return batch.select("id", F.concat(F.lit("a"), "id").alias("answer"))

    with pytest.raises(Exception, match="killed"):
        resume.run(pending(), work, folder, every=None)
    assert resume.run(pending(), work, folder, every=None) == "done"
    got = sorted((r.id, r.answer, r.batch) for r in resume.answers(spark, folder, "id long, answer string").collect())
    assert got == [(10 * k + i, f"a{10 * k + i}", k) for k in range(4) for i in range(3)]
    assert worked == [[0, 1, 2], [10, 11, 12], [20, 21, 22], [20, 21, 22], [30, 31, 32]]
    resume.ask_to_stop(spark, folder)
    put(queue, "9.json", [{"id": 99}])
    assert resume.run(pending(), work, folder, every=None) == "stopped" and len(worked) == 5
    other = str(tmp_path / "other")
    assert resume.run(pending(), lambda b: b.select("id", F.lit("x").alias("answer")), other, every="1 second", budget_seconds=20) == "timeout"
    assert resume.answers(spark, other, "id long, answer string").count() == 13
    assert resume.answers(spark, str(tmp_path / "none"), "id long, answer string").count() == 0
