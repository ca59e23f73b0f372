"""Queries of training-set builders, nested columns and provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.functions import stemming
from askloom.functions import text as X
from askloom.operators import retrieval as R
from askloom.plans.common import QA, qa_pool, table, words_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


@query("triplets", f"""WITH nb AS (SELECT a.vec_id AS q, b.vec_id AS p, 'a' || (b.vec_id % 7) AS answer, 'a' || (a.vec_id % 7) AS own, {COS} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT q, max(p) FILTER (good AND rn = 1) AS positive, max(p) FILTER (NOT good AND rn = 1) AS negative FROM (SELECT *, answer = own AS good, row_number() OVER (PARTITION BY q, answer = own ORDER BY sim DESC, p) AS rn FROM nb)
    GROUP BY q HAVING max(p) FILTER (good AND rn = 1) IS NOT NULL AND max(p) FILTER (NOT good AND rn = 1) IS NOT NULL""")
def triplets(spark, d):
    """For each question the nearest row with its answer, itself left out, and the nearest with another."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"), (F.col("vec_id") % 7).alias("answer"))
    same = v.withColumn("label", F.col("label") * 7 + F.col("answer"))
    positive = R.dense_top_k(same, same, 1, "label", drop_self=True).select("q", F.col("p").alias("positive"))
    negative = R.dense_top_k(v, v, 1, "label", differ="answer").select("q", F.col("p").alias("negative"))
    return positive.join(negative, "q")


@query("stemmed_tokens")
def stemmed_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.words_ascii(F.col("text")).alias("w"))
    return t.select("doc_id", F.size(F.array_distinct(stemming.stems(F.col("w")))).cast("long").alias("n_stems"))


@query("nfkc_lengths")
def nfkc_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(stemming.nfkc(F.col("text"))).cast("long").alias("n"))


@query("prompt_fit", f"""WITH {QA}, e AS (SELECT q.id AS q, p.id AS p, length(p.input) + length(p.output) AS n, row_number() OVER (PARTITION BY q.id ORDER BY abs(q.turn - p.turn), p.id) AS rank FROM qa q JOIN qa p ON q.conv_id = p.conv_id AND q.id <> p.id),
    r AS (SELECT *, sum(n) OVER (PARTITION BY q ORDER BY rank) AS held FROM e) SELECT q, string_agg(p, '|' ORDER BY rank) AS examples FROM r WHERE held <= 2500 GROUP BY q""")
def prompt_fit(spark, d):
    """Examples for a prompt, nearest first, as long as they fit the budget."""
    p = qa_pool(spark, d)
    pairs = p.select("conv_id", F.col("id").alias("q"), F.col("turn").alias("qt")).join(p.select("conv_id", F.col("id").alias("p"), F.col("turn").alias("pt"), (F.length("input") + F.length("output")).alias("n")), "conv_id").where("q <> p")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.abs(F.col("qt") - F.col("pt")), "p")))
    fits = ranked.withColumn("held", F.sum("n").over(Window.partitionBy("q").orderBy("rank"))).where("held <= 2500")
    return fits.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"]), "|").alias("examples"))


@query("pool_with_source", "SELECT 'labels::' || doc_id AS id, 'labels' AS _source FROM labels UNION ALL SELECT 'benchmark::' || item_id, 'benchmark' FROM benchmark")
def pool_with_source(spark, d):
    part = lambda name, key: table(spark, d, name).select(F.concat(F.lit(f"{name}::"), F.col(key).cast("string")).alias("id"), F.lit(name).alias("_source"))
    return part("labels", "doc_id").unionByName(part("benchmark", "item_id"))


@query("json_candidates", f"WITH {QA} SELECT conv_id, count(*) AS n, string_agg(output, chr(31) ORDER BY turn) AS joined FROM qa GROUP BY conv_id")
def json_candidates(spark, d):
    """A conversation's answers as a JSON list in a cell, and read back."""
    cell = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("turn", "output"))), lambda x: x["output"]))
    held = qa_pool(spark, d).groupBy("conv_id").agg(cell.alias("cands"))
    back = held.select("conv_id", F.from_json("cands", "array<string>").alias("a"))
    return back.select("conv_id", F.size("a").cast("long").alias("n"), F.array_join("a", "\x1f").alias("joined"))


@query("cyclic_shifts", "SELECT vec_id, k AS shift, [embedding[1 + k % 3], embedding[1 + (k + 1) % 3], embedding[1 + (k + 2) % 3]]::DOUBLE[]::VARCHAR <> '' AS ok, (embedding[1 + k % 3])::DOUBLE AS first FROM embeddings, range(3) t(k)")
def cyclic_shifts(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("o"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shift"))
    turned = F.concat(F.slice("o", F.col("shift") + 1, F.lit(3)), F.slice("o", F.lit(1), F.col("shift")))
    return e.select("vec_id", F.col("shift").cast("long").alias("shift"), (F.size(turned) == 3).alias("ok"), F.get(turned, F.lit(0)).cast("double").alias("first"))


@query("few_shot_filter", f"WITH {QA}, f AS (SELECT *, length(output) BETWEEN 50 AND 400 AS good, count(*) FILTER (length(output) BETWEEN 50 AND 400) OVER (PARTITION BY subset) AS n FROM qa) SELECT id, subset FROM f WHERE good OR n < 3")
def few_shot_filter(spark, d):
    """Answers of a fitting length; a subset with under three of them keeps all."""
    good = F.length("output").between(50, 400) & ~X.is_refusal(F.col("output"))
    n = F.count_if(good).over(Window.partitionBy("subset"))
    return qa_pool(spark, d).select("id", "subset", good.alias("good"), n.alias("n")).where("good OR n < 3").select("id", "subset")


@query("wide_meta", f"WITH {QA} SELECT id, length(input)::VARCHAR AS in_chars, CASE WHEN turn > 0 THEN len({words_sql('output')})::VARCHAR END AS out_words FROM qa")
def wide_meta(spark, d):
    """A map of open-ended notes, widened to one column per key."""
    notes = F.map_filter(F.create_map(F.lit("in_chars"), F.length("input").cast("string"), F.lit("out_words"), F.when(F.col("turn") > 0, F.size(X.words(F.col("output"))).cast("string"))), lambda k, v: v.isNotNull())
    held = qa_pool(spark, d).select("id", notes.alias("meta"))
    return held.select("id", *[F.col("meta")[k].alias(k) for k in ("in_chars", "out_words")])


@query("config_diff", "SELECT 'k' AS key, count(*) AS changed FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 50")
def config_diff(spark, d):
    """Keys whose value differs from the default map, counted over the log."""
    default = F.create_map(F.lit("k"), F.lit("50"))
    own = table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("own"))
    changed = F.explode(F.map_keys(F.map_filter("own", lambda k, v: v != F.element_at(default, k)))).alias("key")
    return own.select(changed).groupBy("key").agg(F.count("*").alias("changed"))
