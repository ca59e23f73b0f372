"""Tables that an iterative operator writes between its rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder is made where it is unset, on a cluster that is an error."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="askloom-rounds-")
        spark.conf.set(SETTING, folder)
    return folder


class Rounds:
    """Tables of successive rounds: each is written as Parquet and read again, so plans stay short and a lost executor
    costs one round; of each name the tables before the last `held` are deleted."""

    def __init__(self, spark: SparkSession, held: int = 2):
        self.spark, self.held = spark, held
        self.folder = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        paths = self.paths.setdefault(name, [])
        paths.append(path)
        while len(paths) > self.held:
            remove(self.spark, paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
