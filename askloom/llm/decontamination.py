"""Benchmark decontamination (op 10) by a distributed positional inverted index, in DataFrame functions only.

The postings (document, position, term) of all terms that the benchmark holds are written once as Parquet. A window
of `size` benchmark words is looked up from its rarest term: the postings of that term, moved by its offset, are the
candidates; those of the second rarest are intersected with them, then all others at once, by equal document and
position. What is left is an exact match. proximity() returns the places where all words of a window stand within a
span, in any order.

A document is known by its id and a hash of its text, so repeated ids with other texts stay apart and repeated rows
get the same result; a null id is an id of its own. Null and empty texts have no words and no hits; benchmark items
without words are in no window. Only the two id columns and the two texts are read. Benchmark tables are broadcast
only after their rows are counted; beyond the bound they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm.common import cut, held, lower_ascii, table, written

SIZE = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
NO_ID = -(1 << 63)
DOC = ["id", "h"]


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows. df is written or checkpointed, so counting is cheap."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tokens(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BREAK), lambda w: w != "")


def keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, h, t and the key as it was."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def windows(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and phrase (array of words): every window of the item, or the whole item if it is shorter."""
    own = items.select(F.col(key).alias("item_id"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("phrase")).distinct()


def index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written postings id, h, pos, term of the given terms."""
    own = keys(docs, key, text)
    own = own.select(*DOC, held(tokens(F.col("t"))).alias("w"))
    out = own.select(*DOC, F.posexplode("w").alias("pos", "term")).join(bounded(terms), "term")
    return written(out.select(*DOC, "pos", "term"), "postings")


def ordered(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """phrase with `by`: its words as (tf, at, term), rarest first. Phrases with a word that never occurs go."""
    tf = postings.groupBy("term").agg(F.count("*").alias("tf"))
    rows = phrases.select("phrase", F.posexplode("phrase").alias("at", "term")).join(tf, "term")
    held = rows.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("tf", "at", "term"))).alias("by"))
    return cut(held.where(F.size("by") == F.size("phrase")))


def phrase_hits(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, h, start, phrase: every exact occurrence."""
    own = ordered(phrases, postings)
    by = lambda k, f: F.get("by", F.lit(k))[f]
    first = bounded(cut(own.select("phrase", "by", by(0, "term").alias("term"), by(0, "at").alias("at"))))
    hits = postings.join(first, "term").select(*DOC, (F.col("pos") - F.col("at")).alias("start"), "phrase", "by").where("start >= 0")
    # the second rarest term, where there is one
    second = bounded(cut(own.where(F.size("by") > 1).select(by(1, "term").alias("term")).distinct()))
    lists = postings.join(second, "term", "left_semi")
    wanted = hits.withColumns({"term": by(1, "term"), "pos": F.col("start") + by(1, "at")})
    hits = cut(wanted.where(F.size("by") > 1).join(lists, [*DOC, "pos", "term"], "left_semi").select(*hits.columns).unionByName(wanted.where(F.size("by") == 1).select(*hits.columns)).dropDuplicates([*DOC, "start", "phrase"]))
    # all others, in the documents that are left
    rest = hits.where(F.size("by") > 2)
    lists = postings.join(bounded(cut(rest.select(*DOC).distinct())), DOC, "left_semi").distinct()
    others = F.explode(F.slice("by", 3, SIZE_MAX)).alias("o")
    asked = rest.select(*DOC, "start", "phrase", others).select(*DOC, "start", "phrase", (F.col("start") + F.col("o.at")).alias("pos"), F.col("o.term").alias("term"))
    full = asked.join(lists, [*DOC, "pos", "term"]).groupBy(*DOC, "start", "phrase").agg(F.count("*").alias("n")).where(F.col("n") == F.size("phrase") - 2)
    return full.select(*DOC, "start", "phrase").unionByName(hits.where(F.size("by") <= 2).select(*DOC, "start", "phrase")).distinct()


SIZE_MAX = 1 << 20


def proximity(docs: DataFrame, items: DataFrame, size: int = SIZE, span: int = 2 * SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, at, item_id: places `at` of a window's rarest word with all its other words within `span` words of it."""
    asked = cut(windows(items, size))
    postings = index(docs, cut(asked.select(F.explode("phrase").alias("term")).distinct()), key, text)
    own = ordered(asked.select("phrase").distinct(), postings)
    first = bounded(cut(own.select("phrase", F.get("by", F.lit(0))["term"].alias("term"))))
    near = postings.join(first, "term").select(*DOC, F.col("pos").alias("at"), "phrase").distinct()
    need = F.explode(F.array_distinct("phrase")).alias("term")
    block = F.floor(F.col("at") / span)
    wanted = near.select("*", need).select("*", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    lists = postings.withColumn("block", F.floor(F.col("pos") / span)).distinct()
    found = wanted.join(lists, [*DOC, "term", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= span)
    whole = found.groupBy(*DOC, "at", "phrase").agg(F.count_distinct("term").alias("n")).where(F.col("n") == F.size(F.array_distinct("phrase")))
    named = whole.join(asked, "phrase").join(keys(docs, key, text).select(*DOC, "key").distinct(), DOC)
    return named.select(F.col("key").alias(key), "at", "item_id").distinct()


def hits_by_document(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h, n_hit, items of the documents that hold a window."""
    asked = cut(windows(items, size))
    postings = index(docs, cut(asked.select(F.explode("phrase").alias("term")).distinct()), key, text)
    found = cut(phrase_hits(postings, asked.select("phrase").distinct()))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["n"] + F.greatest(x["start"] + x["n"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"))
    spans = found.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("start", F.size("phrase").alias("n")))).alias("s"))
    spans = spans.select(*DOC, F.aggregate("s", nothing, step, lambda a: a["n"]).alias("n_hit"))
    named = found.join(bounded(asked), "phrase").groupBy(*DOC).agg(F.collect_set("item_id").alias("items"))
    return spans.join(named, DOC)


def match_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, n_words, n_hit, n_items, items_sha256, contaminated."""
    own = keys(docs, key, text)
    n_words = F.size(F.filter(F.split("t", BREAK_ANY_CASE), lambda w: w != "")).cast("long")
    found = hits_by_document(docs, items, size, key, text)
    out = own.select("key", *DOC, n_words.alias("n_words")).join(found, DOC, "left")
    names = F.coalesce(F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ","), F.lit(""))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast(T.LongType()).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast(T.LongType()).alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without a hit, with the columns they had."""
    found = hits_by_document(docs, items, size, key, text).select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    own = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("t"))
    own = own.withColumns({"_id": F.coalesce(F.col("key").cast("long"), F.lit(NO_ID)), "_h": F.xxhash64(F.coalesce(F.col("t").cast("string"), F.lit("")))})
    return own.join(bounded(cut(found)), ["_id", "_h"], "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
    bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
    sizes AS (SELECT DISTINCT n FROM bg),
    dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
    hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bg.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) dw JOIN bg ON dw.g = bg.g AND dw.n = bg.n),
    h AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
