"""Queries of model hooks with deterministic stand-ins, and of what surrounds them: prompts, choices, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import prompts as P
from askloom.functions import text as X
from askloom.operators import hooks as H
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


_VOWELS = "[{}, 1.0::DOUBLE]".format(", ".join(f"(length(input) - length(replace(input, '{c}', '')))::DOUBLE" for c in "aeiou"))
_VEC = f"v AS (SELECT id, subset, {_VOWELS} AS x FROM qa)"


@query("hook_encode", f"WITH {QA}, {_VEC} SELECT id, list_transform(x, lambda y: round(y / sqrt(list_dot_product(x, x)), 6)) AS vec FROM v")
def hook_encode(spark, d):
    return qa_pool(spark, d).select("id", F.transform(H.encode(F.col("input"), H.vowel_encoder), lambda y: F.round(y, 6)).alias("vec"))


@query("encoded_topk", f"""WITH {QA}, {_VEC}, s AS (SELECT a.id AS q, b.id AS p, round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 6) AS sim FROM v a JOIN v b ON a.subset = b.subset AND a.id <> b.id)
    SELECT q, p, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS n FROM s) WHERE n <= 2""")
def encoded_topk(spark, d):
    """Questions encoded by a hook, then matched inside their subset."""
    v = qa_pool(spark, d).select("id", "subset", H.encode(F.col("input"), H.vowel_encoder).alias("vec"))
    return R.dense_top_k(v, v, 2, "subset", drop_self=True).select("q", "p", "sim")


@query("hook_cross_encode", f"WITH {QA} SELECT id, round((least(length(input), length(output)) / greatest(length(input), length(output), 1)::DOUBLE + (input = output)::INT) / 2, 6) AS score FROM qa")
def hook_cross_encode(spark, d):
    """The mean of two cross-encoders."""
    return qa_pool(spark, d).select("id", F.round(H.pair_scores(F.col("input"), F.col("output"), [H.length_scorer, H.equal_scorer]), 6).alias("score"))


_JUDGE = "'Rate the answer from 1 to 5.' || chr(10) || 'Question: ' || input || chr(10) || 'Answer: ' || output"


@query("hook_judge", f"WITH {QA} SELECT id, (length({_JUDGE}) % 5 + 1)::DOUBLE AS score, round((length({_JUDGE}) % 5) / 4.0, 6)::DOUBLE AS normal FROM qa")
def hook_judge(spark, d):
    """A judge's completions, parsed and brought from 1..5 to 0..1."""
    prompt = P.fill("Rate the answer from 1 to 5.\nQuestion: {question}\nAnswer: {answer}", question=F.col("input"), answer=F.col("output"))
    score = X.judge_score(H.complete(prompt, H.length_judge))
    return qa_pool(spark, d).select("id", score.alias("score")).select("id", "score", F.round(P.normal_judge(F.col("score")), 6).alias("normal"))


_LAST3 = "array_to_string(list_slice(string_split(input, ' '), -3, -1), ' ')"


@query("hook_generate", f"WITH {QA}, t AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.7::DOUBLE), (2, 0.7::DOUBLE)) s(sample, temperature)) SELECT id, sample::INT AS sample, temperature, {_LAST3} || CASE WHEN sample > 0 THEN ' #' || sample ELSE '' END AS text FROM qa, t")
def hook_generate(spark, d):
    """One greedy answer and two sampled ones."""
    return H.samples(qa_pool(spark, d), "id", "input", H.tail_generator, (0.7,), 2)


@query("hook_translate", f"WITH {QA} SELECT id, CASE WHEN subset <> 's0' AND input IS NOT NULL THEN '[' || subset || '>s0] ' || input ELSE input END AS english FROM qa")
def hook_translate(spark, d):
    """Each distinct text is translated once and joined back."""
    rows = qa_pool(spark, d).withColumn("to", F.lit("s0"))
    return H.translate(rows, "input", "subset", "to", H.tagging_translator, "english").select("id", "english")


@query("translated_view", f"WITH {QA} SELECT id, CASE WHEN subset IN ('s1', 's2') THEN '[' || subset || '>s0] ' || input ELSE input END AS text FROM qa")
def translated_view(spark, d):
    """Only the listed subsets are read in translation."""
    rows = qa_pool(spark, d).withColumn("to", F.when(F.col("subset").isin("s1", "s2"), "s0").otherwise(F.col("subset")))
    return H.translate(rows, "input", "subset", "to", H.tagging_translator, "text").select("id", "text")


@query("hook_choose", f"WITH {QA} SELECT id, list_transform(range(3), lambda k: CASE WHEN k = length(input) % 3 THEN 0.0 ELSE -1.0 - k END::DOUBLE) AS lp FROM qa")
def hook_choose(spark, d):
    return qa_pool(spark, d).select("id", H.choose(F.col("input"), F.lit(3), H.letter_chooser).alias("lp"))


@query("hook_tokens", f"WITH {QA} SELECT id, len({words_sql('input')})::BIGINT AS n_tokens FROM qa")
def hook_tokens(spark, d):
    return qa_pool(spark, d).select("id", H.token_lengths(F.col("input"), H.blank_tokens).alias("n_tokens"))


@query("hook_retry", f"""WITH {QA} SELECT id, CASE WHEN length(input) % 2 = 1 THEN 'answer to ' || length(input) WHEN (length(input) + length(subset || ': ')) % 2 = 1 THEN 'answer to ' || (length(input) + length(subset || ': ')) ELSE input END AS text,
    CASE WHEN length(input) % 2 = 1 THEN 1 WHEN (length(input) + length(subset || ': ')) % 2 = 1 THEN 2 ELSE 3 END AS attempt FROM qa""")
def hook_retry(spark, d):
    """Refused prompts are asked again with the subset in front."""
    rows = qa_pool(spark, d).select("id", "input", F.concat("subset", F.lit(": "), "input").alias("strong"))
    return H.with_retry(rows, "input", "strong", "input", H.shy_generator, X.is_refusal).select("id", "text", "attempt")


@query("bounded_generation", f"WITH {QA}, m AS (SELECT subset, max(conv_id % 4)::INT + 1 AS most FROM qa GROUP BY subset) SELECT id, array_to_string(list_slice(list_filter(string_split_regex(output, '\\s+'), lambda w: w <> ''), 1, most), ' ') AS text FROM qa JOIN m ON qa.subset = m.subset")
def bounded_generation(spark, d):
    """Generations keep to the greatest length of their subset's policy; candidates of a row stay with it."""
    rows = qa_pool(spark, d)
    most = rows.groupBy("subset").agg((F.max(F.col("conv_id") % 4).cast("int") + 1).alias("most"))
    return rows.join(most, "subset").select("id", H.bounded(F.col("output"), F.col("most")).alias("text"))


@query("prompt_messages", f"""WITH {QA} SELECT id, 'Answer in ' || subset || '.' || chr(10) || chr(10) || 'Question: ' || input || chr(10) || 'Answer:' AS prompt, '<|system|>Answer in ' || subset || '.<|user|>' || input || '<|assistant|>' AS rendered FROM qa""")
def prompt_messages(spark, d):
    """A filled template, and the same as messages rendered by a chat template."""
    messages = P.messages(P.fill("Answer in {lang}.", lang=F.col("subset")), F.col("input"))
    return qa_pool(spark, d).select("id", P.fill("Answer in {lang}.\n\nQuestion: {question}\nAnswer:", lang=F.col("subset"), question=F.col("input")).alias("prompt"), P.render(messages, "<|{role}|>{content}", "<|assistant|>").alias("rendered"))


@query("few_shot_prompt", f"""WITH {QA}, n AS (SELECT *, lag(input) OVER w AS i1, lag(output) OVER w AS o1, lag(input, 2) OVER w AS i2, lag(output, 2) OVER w AS o2 FROM qa WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT id, CASE WHEN i2 IS NULL THEN '' ELSE 'Q: ' || i2 || chr(10) || 'A: ' || o2 || chr(10) || chr(10) END || CASE WHEN i1 IS NULL THEN '' ELSE 'Q: ' || i1 || chr(10) || 'A: ' || o1 || chr(10) || chr(10) END || 'Q: ' || input || chr(10) || 'A:' AS prompt FROM n""")
def few_shot_prompt(spark, d):
    """The two turns before as examples."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    shots = F.collect_list(F.struct("turn", "input", "output")).over(w)
    rows = qa_pool(spark, d).withColumn("shots", F.sort_array(shots))
    return rows.select("id", P.few_shot(F.transform("shots", lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"))), F.col("input")).alias("prompt"))


@query("option_prompt", f"WITH {QA} SELECT conv_id, min(input) || chr(10) || string_agg(chr(65 + k::INT) || '. ' || output, chr(10) ORDER BY k) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM qa) WHERE k < 4 GROUP BY conv_id")
def option_prompt(spark, d):
    """A conversation's first four answers behind option letters."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = qa_pool(spark, d).withColumn("k", k).where("k < 4").groupBy("conv_id").agg(F.min("input").alias("input"), F.sort_array(F.collect_list(F.struct("k", "output"))).alias("x"))
    return rows.select("conv_id", P.with_options(F.col("input"), F.transform("x", lambda x: x["output"])).alias("prompt"))


_TOKENS = lambda c: f"regexp_extract_all({c}, '[^ ]+')"


@query("ensemble_routed", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'b' WHEN 'de' THEN 'c' ELSE 'a' END || ':' || source AS pred FROM documents")
def ensemble_routed(spark, d):
    """Three models' predictions as columns; each language has its model, all others the first."""
    rows = table(spark, d, "documents").select("doc_id", "lang", *[F.concat(F.lit(f"{m}:"), "source").alias(m) for m in "abc"])
    return rows.select("doc_id", P.routed({"fr": "b", "de": "c", "es": "missing"}, ["a", "b", "c"], F.col("lang")).alias("pred"))


@query("pooled_cosine", "SELECT vec_id, round(coalesce(list_dot_product(m, r) / nullif(sqrt(list_dot_product(m, m)) * sqrt(list_dot_product(r, r)), 0), 0), 6) AS sim FROM (SELECT vec_id, [(embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2, (embedding[2]::DOUBLE + embedding[4]::DOUBLE) / 2] AS m, [embedding[5]::DOUBLE, embedding[6]::DOUBLE] AS r FROM embeddings)")
def pooled_cosine(spark, d):
    """Mean-pooled token vectors (masked ones left out) against a sentence vector."""
    v = table(spark, d, "embeddings")
    at = lambda *i: F.array(*[F.get("embedding", F.lit(k)).cast("double") for k in i])
    pooled = M.mean_pool(F.array(at(0, 1), at(2, 3), at(6, 7)), F.array(F.lit(True), F.lit(True), F.lit(False)))
    return v.select("vec_id", F.round(F.coalesce(M.cosine(pooled, at(4, 5)), F.lit(0.0)), 6).alias("sim"))
