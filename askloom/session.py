"""Spark session settings used by tests, the benchmark and ad-hoc runs."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> str:
    """Sends this package to all executors as a zip file, for clusters on which it isn't installed; gives the file's path.
    Python functions of the operators are pickled by reference, so workers must be able to import it."""
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="askloom-ship-"), "askloom"), "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE))
    spark.sparkContext.addPyFile(made)
    return made


def local_session(cores: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with adaptive execution on; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("askloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ASKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
