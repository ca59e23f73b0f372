"""Runs that can be stopped, killed and started again: answers are committed by batch id, each once.

A run is a stream of pending rows. Each batch's answers go to the folder of its batch id, replacing what an earlier try
of the same batch left, so a row has one answer after any number of restarts. Batches are at least `every` apart; a
stop file or a used-up time budget ends the run between batches, or within one that is then done again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = "300 seconds"


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def ask_to_stop(spark: SparkSession, folder: str) -> None:
    """Asks the run in `folder` to end; any process that reaches the folder may do so."""
    at, store = _path(spark, f"{folder}/STOP")
    store.create(at, True).close()


def should_stop(spark: SparkSession, folder: str) -> bool:
    at, store = _path(spark, f"{folder}/STOP")
    return store.exists(at)


def answers(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All committed answers, with the batch that made them; no rows before the first."""
    at, store = _path(spark, f"{folder}/answers")
    if not store.exists(at):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/answers")


def run(pending: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, every: str | None = EVERY, budget_seconds: float | None = None, poll_seconds: float = 1.0) -> str:
    """Answers the stream's rows by `work` until no row is left (every=None: all that is there now), a stop is asked for or
    the time is used up; gives done, stopped or timeout. An error of `work` ends the run and is raised."""
    spark = pending.sparkSession
    begun = time.monotonic()

    def commit(batch: DataFrame, batch_id: int) -> None:
        out = work(batch).withColumn("batch", F.lit(batch_id).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/answers")

    if should_stop(spark, folder):
        return "stopped"
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    query = pending.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
    try:
        while not query.awaitTermination(poll_seconds):
            if should_stop(spark, folder):
                return "stopped"
            if budget_seconds is not None and time.monotonic() - begun > budget_seconds:
                return "timeout"
        return "done"
    finally:
        query.stop()
