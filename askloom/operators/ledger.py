"""Champions over an append-only run log, and mixes weighted by share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

KEEP_DELTA = 0.003


def champion_steps(runs: DataFrame, delta: float = KEEP_DELTA) -> DataFrame:
    """subset, seq, run, val, held, won from (subset, seq, run, val, held): each run against the champion before it. A
    first run wins; later ones if val gains delta and held loses at most delta. A subset's runs are one ordered fold: a
    sorted stream of Arrow batches that carries the champion alone, so a subset may have any number of runs."""
    kind = StructType([StructField("subset", runs.schema["subset"].dataType), *(StructField(n, t) for n, t in (("seq", LongType()), ("run", StringType()), ("val", DoubleType()), ("held", DoubleType()), ("won", BooleanType())))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subset, begun, best_val, best_held = None, False, None, None
        for batch in batches:
            subsets = batch.column("subset").to_pylist()
            val, held = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("val", "held"))
            no_val, no_held = (batch.column(n).is_null().to_numpy(zero_copy_only=False) for n in ("val", "held"))
            won = np.zeros(batch.num_rows, bool)
            unknown = np.zeros(batch.num_rows, bool)
            edges = [i for i in range(batch.num_rows) if i == 0 or subsets[i] != subsets[i - 1]]
            for at, stop in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if not begun or subsets[at] != subset:
                    subset, begun, best_val, best_held = subsets[at], True, None, None
                while at < stop:  # up to the next winner
                    if best_val is None:
                        found = at
                    else:
                        gains, keeps = ~(val[at:stop] - best_val < delta), ~(held[at:stop] - (0 if best_held is None else best_held) < -delta)
                        lost = no_held[at:stop] | (best_held is None)
                        wins = np.flatnonzero(gains & keeps & ~no_val[at:stop] & ~lost)
                        found = at + int(wins[0]) if len(wins) else stop
                        n = found - at
                        unknown[at:found] = ((no_val[at:stop] & (keeps | lost)) | (lost & (gains | no_val[at:stop])))[:n]
                    if found < stop:
                        won[found] = True
                        best_val = None if no_val[found] else float(val[found])
                        best_held = None if no_held[found] else float(held[found])
                    at = found + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kind.names[:5]), pa.array(won, mask=unknown)], kind.names)

    own = runs.select("subset", F.col("seq").cast("long").alias("seq"), F.col("run").cast("string").alias("run"), F.col("val").cast("double").alias("val"), F.col("held").cast("double").alias("held"))
    return own.repartition("subset").sortWithinPartitions("subset", "seq", "run", "val", "held").mapInArrow(fold, kind)


def champions(steps: DataFrame) -> DataFrame:
    """The last winner of each subset."""
    return steps.where("won").groupBy("subset").agg(F.max_by(F.struct("run", "val", "held"), "seq").alias("x")).select("subset", "x.*")


def shares(rows: DataFrame, by: str) -> DataFrame:
    own = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def weighted_mean(scores: DataFrame, mix: DataFrame, by: str, value: str) -> DataFrame:
    """The mean over covered groups, their weights scaled to 1; scores are rounded to 4 places before."""
    return scores.join(mix, by).agg(F.round(F.sum(F.col("share") * F.round(value, 4)) / F.sum("share"), 4).alias("score"), F.count("*").alias("covered"))
