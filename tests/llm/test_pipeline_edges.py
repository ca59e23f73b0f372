"""Each stage of the pipeline on nulls in any column, empty texts, repeated ids and rows, more columns, and no rows."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(15)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    item, long = text(14), text(50)
    rows = [(i, text(40), "en", "s0", 1, "clash", None) for i in range(12)]
    rows += [(None, text(40), "en", "s0", None, "clash", 1), (None, None, None, None, None, None, None), (20, None, "en", "s0", 0, "x", 2), (21, "", None, "s1", 0, "x", 2), (22, "  \n ", "en", None, 3, "x", 2)]
    rows += [(30, long, "en", "s0", 1, "one", 1), (30, long, "en", "s0", 1, "one", 1), (30, text(45), "fr", None, 1, "other", 1), (31, long + " " + item, None, "s0", 1, "w", 1), (32, long, "en", "s0", 1, "copy", 1)]
    rows += [(40, text(3000), "en", "s0", 1, "long", 1)]
    folder = tmp_path_factory.mktemp("edges")
    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, h int"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(folder / "full" / "documents.parquet"))
    spark.createDataFrame([], kind).write.parquet(str(folder / "none" / "documents.parquet"))
    for name, items in (("full", [(1, item), (2, None), (3, "")]), ("none", [])):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / name / "benchmark.parquet"))
    return folder, rows


def test_stages_keep_columns_and_whole_rows(spark, tables):
    import corpus_pipeline

    folder, rows = tables
    for name in ("full", "none"):
        at = str(folder / name)
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            out = run(spark, docs, at)
            if k == len(corpus_pipeline.STAGES) - 1:
                assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
                break
            assert out.columns == docs.columns, stage
            out.write.parquet(f"{at}/{k}-{stage}")
            before = {tuple(r) for r in docs.collect()}
            docs = spark.read.schema(out.schema).parquet(f"{at}/{k}-{stage}")
            after = [tuple(r) for r in docs.collect()]
            if stage != "pii":
                assert set(after) <= before, stage  # a stage drops rows and changes none
            if stage == "quality_rules" and name == "full":
                assert all(r[1] and r[1].strip() for r in after) and sum(r[0] == 40 for r in after) == 1
            if stage == "ngram_jaccard_join" and name == "full":
                assert sum(r[0] == 32 for r in after) == 0  # a copy of document 30, which stays
            if stage == "decontamination":
                assert all(r[0] != 31 for r in after)
        if name == "none":
            assert docs.count() == 0


def test_run_on_edges(spark, tables):
    import corpus_pipeline

    folder, _ = tables
    assert corpus_pipeline.run(spark, str(folder / "none")).count() == 0
    packed = corpus_pipeline.run(spark, str(folder / "full")).select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} >= {*range(12), 40} and not {20, 21, 22, 31, 32} & {r.doc_id for r in packed}
