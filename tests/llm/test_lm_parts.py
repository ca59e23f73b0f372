"""LM scoring reads the parts it wrote: another split of the input between scans changes nothing, nor does the tree of sums."""

from __future__ import annotations

import random

import pytest

from askloom.llm import lm_scoring


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 120)))) for i in range(240)] + [(300, None), (301, ""), (None, "ab cd"), (5, "ab cd")]


def scores(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm_scoring.score_documents(df).collect()))


def test_a_new_split_between_scans_changes_nothing(spark, texts, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(12).write.parquet(path)
    docs = lambda: spark.read.parquet(path)
    settings = {"spark.sql.files.maxPartitionBytes": "134217728b", "spark.sql.files.openCostInBytes": "4194304b", "spark.sql.files.minPartitionNum": "8"}
    kept = {k: spark.conf.get(k, None) for k in settings}
    spark.conf.set("spark.sql.files.minPartitionNum", "8")
    whole = scores(docs())
    original = lm_scoring.settings

    def other_split(counts):
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        return original(counts)

    try:
        monkeypatch.setattr(lm_scoring, "settings", other_split)
        assert scores(docs()) == whole and len(whole) == len(texts)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_are_added_up_in_a_tree(spark, texts, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(9).write.parquet(path)
    monkeypatch.setattr(lm_scoring.Parts, "write", classmethod(lambda cls, own, write=lm_scoring.Parts.write.__func__: write(cls, own.repartition(9, "k"))))
    flat = scores(spark.read.parquet(path))
    monkeypatch.setattr(lm_scoring, "TREE", 2)
    assert scores(spark.read.parquet(path)) == flat
