"""Run folders: candidates, sidecars, records, notes and splits. Paths may lie in any store that pyarrow opens."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_LINES = 300


class Store:
    """A folder in a file store: names, bytes, JSON, and commits that readers see whole or not at all."""

    def __init__(self, root: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}" if name else self.root

    def names(self, folder: str = "") -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.path(folder), recursive=True, allow_not_found=True))
        return sorted(x.path[len(self.root.rstrip("/")) + 1 :] for x in found if x.type == fs.FileType.File)

    def exists(self, name: str) -> bool:
        return self.files.get_file_info(self.path(name)).type != fs.FileType.NotFound

    def read(self, name: str) -> bytes:
        with self.files.open_input_stream(self.path(name)) as file:
            return file.read()

    def json(self, name: str, default: object = None) -> object:
        """The file's JSON; the default where there is no file."""
        return json.loads(self.read(name)) if self.exists(name) else default

    def write(self, name: str, held: bytes) -> None:
        """Written beside and moved: a reader never sees half a file."""
        target, beside = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.part")
        self.files.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(beside) as file:
            file.write(held)
        self.files.move(beside, target)

    def commit(self, folder: str, held: dict[str, bytes]) -> list[str]:
        """The folder's files become exactly these: all are written before old ones that are not among them go; the names of those."""
        for name, data in held.items():
            self.write(f"{folder}/{name}", data)
        orphans = [n for n in self.names(folder) if n[len(folder) + 1 :] not in held]
        for name in orphans:
            self.files.delete_file(self.path(name))
        return orphans

    def fetch(self, name: str, folder: str) -> str:
        """A local copy of a file, made once; its path."""
        local = os.path.join(folder, name)
        if not os.path.exists(local):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(local + ".part", "wb") as file:
                file.write(self.read(name))
            os.replace(local + ".part", local)
        return local


def artifact(store: Store, reference: str, folder: str) -> str:
    """run:<id> is a local copy of the run's folder, fetched once; any other reference is a path already."""
    if not reference.startswith("run:"):
        return reference
    run = reference.removeprefix("run:")
    names = store.names(run)
    if not names:
        raise FileNotFoundError(f"no run {run}")
    for name in names:
        store.fetch(name, folder)
    return os.path.join(folder, run)


def locate(candidates: list[str], required: list[str]) -> str:
    """The first folder that holds all required files."""
    for folder in candidates:
        if all(os.path.exists(os.path.join(folder, n)) for n in required):
            return folder
    raise FileNotFoundError(f"none of {candidates} holds {required}")


def yaml_config(path: str) -> dict:
    """A YAML file's settings; an empty file has none. Needs a YAML library, which the rest doesn't."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package") from error
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def stub(name: str):
    """A source that is announced but not built."""

    def load(spark: SparkSession) -> DataFrame:
        raise NotImplementedError(f"source {name} is not built")

    return load


def sidecars(spark: SparkSession, folder: str, fields: dict[str, str]) -> DataFrame:
    """file and the fields of each JSON file of a folder; files that are no JSON objects are left out, values that don't
    fit their type are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    text = F.decode("content", "UTF-8")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"))
    return rows.where(F.col("m").isNotNull() & (F.size("m") > 0)).select("file", *[F.col("m")[k].try_cast(t).alias(k) for k, t in fields.items()])


def run_candidates(spark: SparkSession, folder: str, names: tuple[str, ...] = ("held_out_preds.csv", "test_preds.csv", "oof_lists.csv.gz")) -> DataFrame:
    """ID, candidates (array) from the prediction files that a run's folder has, plain or gzipped; empty parts of a pipe
    list are dropped. A gzipped file is one task, as its format can't be split."""
    made = None
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if not Store(folder).exists(name):
            continue
        rows = spark.read.option("header", True).option("multiLine", not name.endswith(".gz")).option("escape", '"').csv(path)
        part = rows.select("ID", F.filter(F.split("cand_ids", r"\|"), lambda x: x != "").alias("candidates"))
        made = part if made is None else made.unionByName(part)
    if made is None:
        raise FileNotFoundError(f"{folder} has none of {names}")
    return made


def save_splits(splits: DataFrame, folder: str) -> None:
    """One folder of Parquet per value of `split`; only those that come are replaced."""
    splits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(folder)


def save_scores(report: DataFrame, rows: DataFrame, folder: str) -> None:
    """The score table by group as one CSV file (a row per group), and the scores of every row as Parquet."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/report")
    rows.write.mode("overwrite").parquet(f"{folder}/rows")


def record(store: Store, run: str, result: dict, log: list[str]) -> dict:
    """The run's result with its status, and the last lines of its log, committed together."""
    kept = log[-LOG_LINES:]
    store.commit(run, {"result.json": json.dumps(result, ensure_ascii=False, sort_keys=True).encode(), "log.txt": "\n".join(kept).encode()})
    return result | {"log_lines": len(kept)}


def note(store: Store, name: str, body: str, index: str = "index.md") -> bool:
    """Writes a note and adds a bullet to the index, unless it has one: whether it was added."""
    store.write(f"{name}.md", body.encode())
    bullet = f"- [[{name}]]"
    lines = store.read(index).decode().splitlines() if store.exists(index) else []
    if bullet in lines:
        return False
    store.write(index, ("\n".join([*lines, bullet]) + "\n").encode())
    return True


def status_report(specs: DataFrame, claims: DataFrame, results: DataFrame, stale: int = 900) -> DataFrame:
    """run, state: done, failed, running, stale or queued. specs (run), claims (run, age in seconds), results (run, status)."""
    last = claims.groupBy("run").agg(F.min("age").alias("age"))
    told = results.groupBy("run").agg(F.max(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"))
    state = F.when(F.col("ok") == 1, "done").when(F.col("ok") == 0, "failed").when(F.col("age") < stale, "running").when(F.col("age").isNotNull(), "stale").otherwise("queued")
    return specs.select("run").distinct().join(told, "run", "left").join(last, "run", "left").select("run", state.alias("state"))
