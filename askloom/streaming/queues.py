"""Work queues as streams over files; each has a batch twin among the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON lines of a folder as they appear."""
    return spark.readStream.schema(schema).json(folder)


def once_each(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first record of each key; keys are forgotten after `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def to_table(stream: DataFrame, name_or_path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet folder all that is there now; a later start goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", name_or_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
