"""Writers: submissions, logs, ledgers and dumps."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import flatten_lines
from askloom.operators.validation import TARGETS, require


def submission_csv(df: DataFrame, path: str, metadata: dict | None = None) -> int:
    """Checks and writes one CSV folder with a sidecar of metadata; line breaks in answers become blanks. Rows written."""
    require(df, ["ID", *TARGETS])
    bad = df.agg(F.count("*").alias("n"), F.count_distinct("ID").alias("ids"), F.count_if((F.col(TARGETS[0]) != F.col(TARGETS[1])) | (F.col(TARGETS[0]) != F.col(TARGETS[2]))).alias("unequal")).first()
    if bad["n"] != bad["ids"] or bad["unequal"]:
        raise ValueError("ids repeat or targets differ")
    flat = df.select("ID", *[flatten_lines(F.col(t)).alias(t) for t in TARGETS])
    flat.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    if metadata is not None:
        with open(os.path.join(path, ".metadata.json"), "w") as f:
            json.dump(metadata | {"rows": bad["n"]}, f)
    return bad["n"]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def training_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_fold(df: DataFrame, path: str) -> None:
    """Appends a fold's lists under its own folder; writing a fold again replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def embedding_cache(df: DataFrame, path: str) -> None:
    """sha, vec of texts, keyed by their digest."""
    df.select(F.sha1("text").alias("sha"), "vec").write.mode("append").parquet(path)


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small table (a ledger's rows) as Markdown."""
    rows = [[str(v) for v in r] for r in df.select(columns).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *map(line, rows)])
