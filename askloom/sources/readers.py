"""Readers: text tables, logs, specs, prediction files and notes. Every reader gives a DataFrame; only schemas and file names are looked at on the driver."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.text import subset_of
from askloom.operators.validation import require

# fixed values: column names of the data model
RENAMES = {"input": "Question", "output": "Response", "subset": "Language"}
ANSWER_COLUMNS = ("prediction", "answer", "response", "generated", "pred")
SUBMISSION = ("ID", "TargetRLF1", "TargetR1F1", "TargetLLM")


def csv(spark: SparkSession, path: str, na_as_empty: bool = True) -> DataFrame:
    """A CSV file with a header, every column a string. Nulls become empty; "NA" is null only with na_as_empty."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = read.option("nullValue", "NA").csv(path) if na_as_empty else read.csv(path)
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def raw_tables(spark: SparkSession, folder: str, names: dict[str, bool]) -> dict[str, DataFrame]:
    """The CSV files of a folder by name; names says which must be there."""
    found = {n: csv(spark, f"{folder}/{n}.csv") for n in names if os.path.exists(f"{folder}/{n}.csv")}
    if lacking := sorted(n for n, must in names.items() if must and n not in found):
        raise FileNotFoundError(f"missing in {folder}: {', '.join(lacking)}")
    return found


def split_table(spark: SparkSession, folder: str, name: str, allow_sealed: bool = False) -> DataFrame:
    """A processed split; the sealed hold-out only when asked for."""
    if "held_out" in name and not allow_sealed:
        raise PermissionError(f"{name} is sealed")
    return spark.read.parquet(f"{folder}/{name}")


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    twice = df.groupBy(key).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} is not unique")
    return df


def predictions(df: DataFrame, key: str = "ID", column: str | None = None) -> DataFrame:
    """ID, pred_r1, pred_rl, pred_llm from a submission of four columns or from one answer column, found by name."""
    if set(SUBMISSION) <= set(df.columns):
        out = df.select(F.col(key).alias("ID"), F.col("TargetR1F1").alias("pred_r1"), F.col("TargetRLF1").alias("pred_rl"), F.col("TargetLLM").alias("pred_llm"))
    else:
        by_name = {c.lower(): c for c in df.columns}
        name = column or next((by_name[c] for c in ANSWER_COLUMNS if c in by_name), None)
        if name is None:
            raise ValueError(f"no answer column among {df.columns}")
        out = df.select(F.col(key).alias("ID"), *[F.col(name).alias(c) for c in ("pred_r1", "pred_rl", "pred_llm")])
    return unique_ids(out, "ID")


def references(df: DataFrame, key: str = "ID") -> DataFrame:
    require(df, [key, "output"])
    subset = F.col("subset") if "subset" in df.columns else subset_of(F.col(key))
    question = F.col("input") if "input" in df.columns else F.lit("")
    return df.select(F.col(key).alias("ID"), question.alias("question"), F.col("output").alias("reference"), subset.alias("subset"))


def joined(preds: DataFrame, refs: DataFrame, strict: bool = False) -> tuple[DataFrame, int]:
    """Predictions with their references, and how many references lack one."""
    missing = refs.join(preds, "ID", "left_anti").count()
    out = refs.join(preds, "ID")
    if strict and missing:
        raise ValueError(f"{missing} references have no prediction")
    if out.isEmpty():
        raise ValueError("no id in common")
    return out, missing


def parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return require(spark.read.parquet(path), columns).select(columns)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A record per line; blank lines are passed over."""
    return spark.read.schema(schema).json(path)


def specs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file, with its name, in order of name."""
    return spark.read.option("multiLine", True).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("file")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a file that holds one JSON object; no rows if there is no file."""
    if not os.path.exists(path):
        return spark.createDataFrame([], "key string, value string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def pool(spark: SparkSession, files: dict[str, str], columns: list[str]) -> DataFrame:
    """The same columns of several tables, with _source."""
    out = None
    for source, path in files.items():
        part = spark.read.parquet(path).select(*columns, F.lit(source).alias("_source"))
        out = part if out is None else out.unionByName(part)
    return out


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of Markdown files."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("text"))


def fresh(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of texts (text) whose digest the cache (sha) lacks."""
    return texts.withColumn("sha", F.sha1("text")).join(cached.select("sha"), "sha", "left_anti")


_sources: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register(name: str, source: Callable[[SparkSession], DataFrame]) -> None:
    if name in _sources:
        raise ValueError(f"{name} is registered already")
    _sources[name] = source


def registered() -> list[str]:
    return sorted(_sources)


def load(spark: SparkSession, name: str, most: int | None = None) -> DataFrame:
    """A registered source with its name in _source and before each ID; most: rows to take, where that is asked for."""
    df = _sources[name](spark)
    df = df.limit(most) if most is not None else df
    return df.withColumns({"_source": F.lit(name), "ID": F.concat(F.lit(f"{name}::"), F.col("ID").cast("string"))})


BOM = b"\xef\xbb\xbf"


def submission(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A submission's CSV as texts. A byte-order mark at the head of any of its files, or columns that are not the wanted ones
    in their order, raise an error: readers pass over both without a word."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(path)
    for x in store.listStatus(at):
        if x.isFile() and x.getLen() >= len(BOM) and not x.getPath().getName().startswith((".", "_")):
            file = store.open(x.getPath())
            try:
                head = bytes(file.read() for _ in range(len(BOM)))
            finally:
                file.close()
            if head == BOM:
                raise ValueError(f"{x.getPath().toString()} begins with a byte-order mark")
    made = csv(spark, path)
    if made.columns != list(columns):
        raise ValueError(f"columns are {made.columns}, wanted are {list(columns)}")
    return made
