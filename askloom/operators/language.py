"""Language detection with a confidence: scripts and letters first, then naive Bayes over hashed character n-grams, then
marker words.

The model is fitted by aggregation: each Arrow batch counts the hashed runs of one to three characters of its texts by
language, Spark adds the counts up, and languages x buckets numbers make the model, whatever the number of texts. Texts
are scored whole, in Arrow batches. The runs of a text overlap, so its likelihood is taken as that of a third of them,
and of at most EVIDENCE; the confidence is the posterior of the best language.

Null and blank texts are of language "und" with confidence 0 and train nothing, as do rows with a null language. Ties go
to the first name. A model fitted on no rows finds nothing, so only rules and markers speak.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
LANGUAGES_MAX = 512
EVIDENCE = 60
CHUNK = 1 << 20
# fixed values: scripts, letters and marker words of the languages, and the confidences of rules
ETHIOPIC = r"[ሀ-፿ᎀ-᎟ⶀ-⷟꬀-꬯]"
AKAN_LETTERS = r"[ɛɔƐƆ]"
AKAN_WORDS = r"(?iU)\b(wo|ne|ma|me|yɛ|mmuaeɛ|asɛmmisa|adwuma)\b"
LUGANDA_WORDS = r"(?iU)\b(n'|na|ne|omu|aba|eby|ky|eky|ko|mu|olw)\b|\bekibuuzo\b|\beky'okuddamu\b"
SWAHILI_WORDS = r"(?iU)\b(na|ya|wa|ni|kwa|kuhusu|ninaweza|habari|mimi|swali|jibu|afya)\b"
MODEL_LEAST = 0.3


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all runs of one to three characters, CHUNK characters at a time."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    for a in range(0, len(codes), CHUNK):
        part = codes[a : a + CHUNK + 2]
        size = min(CHUNK, len(codes) - a)
        held = np.zeros(len(part), np.uint64)
        for n in range(3):
            held = held[: len(part) - n] * np.uint64(0x9E3779B97F4A7C15) + (part[n:] + np.uint64(n + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield ((held[:size] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    names: list[str]
    logs: np.ndarray  # a row of log-probabilities a language
    prior: np.ndarray

    def posterior(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not text.strip():
            return "und", 0.0
        total, n = np.zeros(len(self.names)), 0
        for part in grams(text):
            total += self.logs @ np.bincount(part, minlength=BUCKETS)
            n += len(part)
        score = total / n * min(n / 3, EVIDENCE) + self.prior
        odds = np.exp(score - score.max())
        best = int(np.argmax(odds))
        return self.names[best], float(odds[best] / odds.sum())


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", languages_max: int = LANGUAGES_MAX) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))  # the last counts texts
                own[BUCKETS] += 1
                for part in grams(t.as_py()):
                    own[:BUCKETS] += np.bincount(part, minlength=BUCKETS)
            if len(held) > 64:  # a bound on what a task holds, where languages are many
                yield from _out(held)
                held = {}
        yield from _out(held)

    def _out(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    own = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t")).where("lang IS NOT NULL AND trim(coalesce(t, '')) <> ''")
    counts = own.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in counts.where(F.col("bucket") == BUCKETS).limit(languages_max + 1).select("lang").collect())
    if len(names) > languages_max:
        raise ValueError(f"more than {languages_max} languages")
    table = np.zeros((len(names), BUCKETS + 1))
    at = {name: i for i, name in enumerate(names)}
    for r in counts.collect():  # languages x buckets at most
        table[at[r.lang], r.bucket] = r.n
    smoothed = table[:, :BUCKETS] + 0.5
    texts = table[:, BUCKETS]
    return Model(names, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)), np.log((texts + 1) / (texts.sum() + len(names))))


def found(lang: Column | str, confidence: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(lang).alias("lang"), lit(confidence).cast("double").alias("confidence"))


def by_script(text: Column) -> Column:
    """Ethiopic letters, or Akan letters with an Akan word; else null."""
    return F.when(text.rlike(ETHIOPIC), found("amh", 1.0)).when(text.rlike(AKAN_LETTERS) & text.rlike(AKAN_WORDS), found("aka", 0.9))


def by_markers(text: Column) -> Column:
    """Akan letters or words, else the more frequent of Luganda's and Swahili's words, Swahili at ties; else null."""
    lug, swa = (F.regexp_count(text, F.lit(x)) for x in (LUGANDA_WORDS, SWAHILI_WORDS))
    share = lambda n: F.least(0.6 + 0.05 * n, F.lit(0.9))
    akan = text.rlike(AKAN_LETTERS) | text.rlike(AKAN_WORDS)
    return F.when(akan, found("aka", 0.7)).when(lug > swa, found("lug", share(lug))).when(swa > 0, found("swa", share(swa)))


def detect(rows: DataFrame, model: Model | None = None, text: str = "text", name: str = "detected", least: float = MODEL_LEAST) -> DataFrame:
    """rows with a struct (lang, confidence): of the script, else of the model if it is sure enough, else of marker words,
    else "und" and 0."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    steps = [by_script(t)]
    if model is not None:

        def score(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([model.posterior(x) for x in texts], columns=["lang", "confidence"])

        said = F.pandas_udf(score, "lang string, confidence double")(t)
        rows = rows.withColumn("_said", said)
        steps.append(F.when(F.col("_said.confidence") >= least, F.col("_said")))
    return rows.withColumn(name, F.coalesce(*steps, by_markers(t), found("und", 0.0))).drop("_said")


def confusion(rows: DataFrame, lang: str = "lang", detected: str = "detected") -> DataFrame:
    """lang, found, n, mean confidence."""
    return rows.groupBy(F.col(lang).alias("lang"), F.col(detected)["lang"].alias("found")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(detected)["confidence"]), 6).alias("confidence"))
