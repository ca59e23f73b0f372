"""Importance resampling towards a target distribution (op 12) on hashed n-gram features.

Identical texts are collapsed first, by grouping the full text: features are taken once a distinct text, and its counts
are multiplied by how often it occurs. A text's features are all runs of one to three words, hashed by crc32 into
buckets. The buckets' counts over documents and target give each bucket a gain; a text's weight is the sum over its
features. Weights are joined back to the documents by SHA-256 of the text; only then comes the noise of each document,
so copies have equal weights and different scores. Documents of at least `least` words are ranked by score; the best
are drawn.

The bucket tables have 10,000 rows at any size, so the driver holds them; every Arrow batch adds at most as many rows to
the sum. Distinct texts are written once and read for the counts and for the weights. Long texts are hashed word by
word, without an array of features beyond one text. Documents are ranked in ranges of the score whose sizes are summed,
so no task holds them all.

A null or empty text has no words: no features, weight 0; it gets a score and is never drawn. A null id is drawn after
all others of its score and takes part in the noise as `42:`. Repeated rows are drawn one by one, with ranks in any
order among themselves. An empty target has T = 0; an empty table of documents gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.common import table, written

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
RANGES = 512
#: What parts words, on UTF-8 bytes with A-Z lower-cased: all of ASCII but letters and digits.
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return [w for w in BREAK.split((text or "").encode().lower()) if w]


def buckets(own: list[bytes]) -> np.ndarray:
    """The bucket of each run of one to three words; crc32 goes on from the run before."""
    crc, out = zlib.crc32, []
    spaced = [b" " + w for w in own]
    before = [crc(w) for w in own]
    out += before
    for n in range(1, RUN):
        before = list(map(crc, spaced[n:], before))
        out += before
    return np.array(out, np.int64) % BUCKETS


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """t, n: each full text once, with its number of rows. Partial sums go before the shuffle, so copies don't meet in one task."""
    return docs.groupBy(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).agg(F.count("*").alias("n"))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows: BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                np.add(held, n * np.bincount(buckets(words(t.as_py())), minlength=BUCKETS), out=held)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    rows = texts.select("t", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(...)) of each bucket, smoothed by one."""
    s, t = int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * (s + BUCKETS) / (float(a + 1) * (t + BUCKETS)))) for a, b in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """h, n_words, n_features, weight of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for t in batch.column(1):
                own = words(t.as_py())
                found = buckets(own)
                n_words.append(len(own))
                n_features.append(len(found))
                weight.append(int(gain[found].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]], ["h", "n_words", "n_features", "weight"])

    return texts.select(sha("t").alias("h"), "t").mapInArrow(run, "h binary, n_words long, n_features long, weight long")


def sha(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The key, n_words, n_features, weight and score of every row of docs."""
    texts = written(distinct_texts(docs, text), "texts")
    gain = gains(bucket_counts(texts), bucket_counts(distinct_texts(target, target_text)))
    own = docs.select(F.col(key).cast("long").alias(key), sha(text).alias("h"))
    out = own.join(written(weigh(texts, gain), "weights"), "h").drop("h")
    return out.withColumn("score", F.col("weight") + noise(F.col(key)))


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3... for the drawn rows by descending score and ascending key, null for all others."""
    own = written(scored, "scores")
    asked = own.where(F.col("n_words") >= least)
    many = percent * asked.count() // 100
    if not many:
        return own.withColumn("rank", F.lit(None).cast("long"))
    # edges inside the part to be drawn and a little beyond; what they miss is made good by exact sizes
    part = min(1.0, 1.1 * percent / 100 + 0.002)
    edges = sorted({int(x) for x in asked.approxQuantile("score", [1 - part * k / RANGES for k in range(1, RANGES + 1)], part / RANGES)})
    above = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("score")))
    own = own.withColumn("r", F.when(F.col("n_words") >= least, F.when(F.col("score") < edges[0], len(edges)).otherwise(above)))
    ahead, before = {}, 0
    for r, n in sorted(map(tuple, own.where("r IS NOT NULL").groupBy("r").agg(F.count("*")).collect())):
        if before < many:
            ahead[r] = before
        before += n
    drawn = F.coalesce(F.col("r") <= max(ahead), F.lit(False))
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), F.asc_nulls_last(key))) + F.element_at(F.create_map(*[F.lit(x) for pair in ahead.items() for x in pair]), F.col("r"))
    ranked = own.where(drawn).withColumn("place", place).withColumn("rank", F.when(F.col("place") <= many, F.col("place")).cast("long"))
    return ranked.drop("r", "place").unionByName(own.where(~drawn).drop("r").withColumn("rank", F.lit(None).cast("long")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB SQL for the query; crc32 from its polynomial, folded over the bytes of each distinct feature."""
    cut = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    runs = "w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]"
    return f"""
    WITH tab AS (
      SELECT list(c ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
    d AS (SELECT doc_id, {cut} AS w FROM documents),
    df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({runs}) AS f FROM d) GROUP BY ALL),
    bf AS (SELECT f, count(*) AS n FROM (SELECT unnest({runs}) AS f FROM (SELECT {cut} AS w FROM benchmark)) GROUP BY f),
    x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
    b AS (
      SELECT f, xor(list_reduce(list_prepend(4294967295, [16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 FOR i IN range(0, len(h) // 2)]::BIGINT[]),
        lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM x, tab),
    own AS (SELECT doc_id, bucket, sum(n) AS n FROM df JOIN b ON df.f = b.f GROUP BY ALL),
    s AS (SELECT bucket, sum(n)::BIGINT AS n FROM own GROUP BY bucket),
    t AS (SELECT bucket, sum(n)::BIGINT AS n FROM bf JOIN b ON bf.f = b.f GROUP BY bucket),
    g AS (
      SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + {BUCKETS}) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
      FROM s LEFT JOIN t ON s.bucket = t.bucket),
    wt AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM own JOIN g ON own.bucket = g.bucket GROUP BY doc_id),
    sc AS (
      SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN wt ON d.doc_id = wt.doc_id),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_words >= {LEAST_WORDS})
    SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM sc LEFT JOIN r ON sc.doc_id = r.doc_id"""
