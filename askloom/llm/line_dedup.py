"""Line dedup (op 13) over levelled sorted runs of line hashes.

LineRuns is the store: each run is a table of distinct line keys (128 bits of MD5), bucketed and sorted by key, with the
number of documents that hold the key and, in the run that saw it first, the document that keeps it. A new batch is
merge-anti-joined with the runs: keys that no run knows get their keeper from the batch, known keys only add their
count; the batch's own run follows. As all runs are bucketed alike, these are sort-merge joins without a shuffle of the
runs. When a level has `fanout` runs they are merged into one of the next level and their files go, so a key is
rewritten once a level.

drop_positions() deals the documents into batches by descending id, so the keeper is the largest id that holds the line.
Lines of keys in at least `least_docs` documents go from all other documents. The lines of all batches are cut and
hashed once, and written by batch. Keys are counted by partial sums and the frequent ones are broadcast only after they
were counted; beyond the bound they are joined by a shuffle whose hot keys Spark can split.

A null or empty text is one empty line. Null ids are one document, smaller than all others. Rows that repeat an id
count as one document; each row loses its own lines. Ties can't occur, as a key is held by one largest id; if several
rows have it, all of them keep their lines. Empty tables give no rows. Only the id and the text are read by
score_documents(); drop_lines() returns all columns as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import cut, lower_ascii, removed, shared_dir, table, written

NO_ID = -(1 << 63)
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FANOUT = 8, 4
BROADCAST_ROWS = 200_000
ROW = ["id", "th"]


class LineRuns:
    """Levelled runs of (h, n, top): key, documents that hold it, keeper (null where an earlier run has it)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = f"{folder or shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _path(self, run: str) -> str:
        return f"{self.folder}/{run}"

    def _write(self, rows: DataFrame, level: int) -> None:
        run = f"lines_{uuid.uuid4().hex}"
        rows.select("h", "n", "top").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", self._path(run)).saveAsTable(run)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def runs(self) -> list[DataFrame]:
        """Larger levels first."""
        return [self.spark.table(run) for level in reversed(self.levels) for run in level]

    def known(self, keys: DataFrame) -> DataFrame:
        """keys (h, distinct) with `fresh`: no run holds h."""
        out, marks = keys, []
        for k, run in enumerate(self.runs()):
            out = out.join(run.select("h", F.lit(True).alias(f"in{k}")), "h", "left")
            marks.append(F.col(f"in{k}").isNull())
        fresh = F.lit(True)
        for mark in marks:
            fresh = fresh & mark
        return out.select(*keys.columns, fresh.alias("fresh"))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch's keys (h, n, top; h distinct) as a run, and compacts full levels."""
        self._write(self.known(keys).select("h", "n", F.when(F.col("fresh"), F.col("top")).alias("top")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._sum(merged), level + 1)
            self._drop(merged)
            level += 1

    def _sum(self, runs: list[str]) -> DataFrame:
        # read as plain files: a union of bucketed tables claims a partitioning that its columnar scan doesn't have (Spark 4.1)
        rows = self.spark.read.schema("h binary, n long, top long").parquet(*[self._path(run) for run in runs])
        return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def totals(self) -> DataFrame:
        """h, n, top over all runs; no rows where nothing was added."""
        runs = [run for level in self.levels for run in level]
        return self._sum(runs) if runs else self.spark.createDataFrame([], "h binary, n long, top long")

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            removed(self.spark, self._path(run))

    def close(self) -> None:
        self._drop([run for level in self.levels for run in level])
        self.levels = [[]]
        removed(self.spark, self.folder)


def row_keys(key: str, text: str) -> list[Column]:
    """id, th and t of a row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("th"), t.alias("t")]


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, th, pos (from 0), h of every line whose key has at least `least_chars` code points."""
    own = docs.select(*row_keys(key, text)).select("*", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    own = own.select(*ROW, "pos", F.btrim("line", F.lit(BLANKS)).alias("k")).where(F.length("k") >= least_chars)
    return own.select(*ROW, "pos", F.unhex(F.md5(lower_ascii(F.col("k")))).alias("h"))


def drop_positions(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """id, th, drops: the sorted positions of the lines that a document loses, where it loses any."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"))
    edges = (ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []) if batches > 1 else []
    batch = F.lit(0)
    for edge in edges:  # descending ids: the largest are batch 0
        batch = batch + (F.col("id") <= edge).cast("int")
    path = f"{shared_dir(spark)}/cut-lines-{uuid.uuid4().hex}"
    made = lines(docs, key, text, least_chars).withColumn("batch", batch)
    made.write.partitionBy("batch").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    store = LineRuns(spark)
    for b in range(batches):
        # two steps, as rows may repeat an id: documents of a key, then their number
        held = made.where(F.col("batch") == b).select("h", "id").distinct()
        store.add(held.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    often = cut(store.totals().where(F.col("n") >= least_docs).select("h", "top"))
    store.close()
    few = often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = made.join(F.broadcast(often) if few else often, "h").where(F.col("id") < F.col("top"))
    return gone.groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def rest(text: Column, drops: Column) -> Column:
    """The text without the lines at the sorted positions `drops`, in time linear in its lines: slices between drops."""
    own = F.split(text, "\n")
    edges = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(own)))
    kept = F.transform(F.sequence(F.lit(0), F.size(drops)), lambda i: F.slice(own, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1))
    return F.when(drops.isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The key, n_lines, n_dropped and the text that is left, one row per row of docs."""
    own = docs.select(F.col(key).alias("key"), *row_keys(key, text))
    out = own.join(drop_positions(docs, key, text, **limits), ROW, "left")
    return out.select(F.col("key").alias(key), F.size(F.split("t", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), rest(F.col("t"), F.col("drops")).alias("kept_text"))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """docs with the lines taken out of the text column; null texts stay null."""
    own = docs.select(F.struct("*").alias("row"), *row_keys(key, text))
    own = own.join(drop_positions(docs, key, text, **limits), ROW, "left")
    left = F.when(F.col("drops").isNull(), F.col("row")[text]).otherwise(rest(F.col("t"), F.col("drops")))
    return own.select(F.col("row").withField(text, left).alias("row")).select("row.*")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM d),
    k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
    often AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < often.top, false) AS gone FROM k LEFT JOIN often ON k.k = often.k)
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
