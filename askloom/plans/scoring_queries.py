"""Queries of tokenizers, text functions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import text as X
from askloom.plans.common import OVERLAP, PREV, QA, previous_answers, qa_pool, table, words_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R1 = f"""tok AS (SELECT id, subset, {words_sql('pred')} AS pt, {words_sql('output')} AS rt FROM prev), {OVERLAP},
    r1 AS (SELECT tok.id, tok.subset, CASE WHEN len(pt) > 0 AND len(rt) > 0 THEN 2.0::DOUBLE * coalesce(ov, 0)::DOUBLE / (len(pt) + len(rt)) ELSE 0.0 END AS r1 FROM tok LEFT JOIN ov ON tok.id = ov.id)"""
LCS = """steps(id, i, prow) AS (
      SELECT id, 0, list_transform(range(len(rt) + 1), lambda x: 0) FROM tok
      UNION ALL
      SELECT s.id, s.i + 1, list_prepend(0, list_transform(range(1, len(t.rt) + 1), lambda j:
        list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN t.rt[k::INT] = t.pt[(s.i + 1)::INT] THEN greatest(s.prow[(k + 1)::INT], s.prow[k::INT] + 1) ELSE s.prow[(k + 1)::INT] END))))
      FROM steps s JOIN tok t ON s.id = t.id WHERE s.i < len(t.pt))"""


@query("qa_pool", f"WITH {QA} SELECT id, input, output, subset FROM qa")
def qa(spark, d):
    return qa_pool(spark, d).select("id", "input", "output", "subset")


@query("rouge1_by_lang", f"WITH {PREV}, {R1} SELECT subset, count(*) AS n, round(avg(r1), 6) AS rouge1 FROM r1 GROUP BY subset")
def rouge1_by_subset(spark, d):
    rows = previous_answers(spark, d).select("subset", M.rouge1(X.words(F.col("pred")), X.words(F.col("output"))).alias("r1"))
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.round(F.avg("r1"), 6).alias("rouge1"))


@query("score_all_rollup")
def score_all(spark, d):
    """Mean ROUGE-1 and ROUGE-L by subset with an ALL row, of copying the answer before."""
    p, r = X.words(F.col("pred")), X.words(F.col("output"))
    rows = previous_answers(spark, d).select("subset", M.rouge1(p, r).alias("r1"), M.rouge_l(p, r).alias("rl"))
    means = [F.count("*").alias("n"), F.round(F.avg("r1"), 4).alias("rouge1"), F.round(F.avg("rl"), 4).alias("rougeL"), F.round(F.avg(M.W_R1 * F.col("r1") + M.W_RL * F.col("rl")), 4).alias("rouge_only")]
    return rows.rollup("subset").agg(*means).withColumn("subset", F.coalesce("subset", F.lit("ALL")))


@query("rouge1_rollup", f"WITH {PREV}, {R1} SELECT coalesce(subset, 'ALL') AS subset, count(*) AS n, round(avg(r1), 6) AS rouge1 FROM r1 GROUP BY ROLLUP (subset)")
def rouge1_rollup(spark, d):
    rows = previous_answers(spark, d).select("subset", M.rouge1(X.words(F.col("pred")), X.words(F.col("output"))).alias("r1"))
    return rows.rollup("subset").agg(F.count("*").alias("n"), F.round(F.avg("r1"), 6).alias("rouge1")).withColumn("subset", F.coalesce("subset", F.lit("ALL")))


BENCH = f"""prev AS (SELECT a.item_id AS id, 'all' AS subset, a.text AS pred, b.text AS output FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
    tok AS (SELECT id, subset, {words_sql('pred')} AS pt, {words_sql('output')} AS rt FROM prev)"""


@query("rougeL_pairs", f"WITH RECURSIVE {BENCH}, {LCS} SELECT t.id, prow[len(rt) + 1]::BIGINT AS lcs, round(2.0 * prow[len(rt) + 1] / (len(pt) + len(rt)), 6) AS rouge_l FROM steps s JOIN tok t ON s.id = t.id AND s.i = len(t.pt)")
def rouge_l_pairs(spark, d):
    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("output"))
    rows = b.join(nxt, "item_id").select(F.col("item_id").alias("id"), X.words(F.col("text")).alias("p"), X.words(F.col("output")).alias("r"))
    return rows.select("id", M.lcs(F.col("p"), F.col("r")).cast("long").alias("lcs"), F.round(M.rouge_l(F.col("p"), F.col("r")), 6).alias("rouge_l"))


@query("answer_overlap_pairs", f"""WITH RECURSIVE {BENCH}, {LCS}, {OVERLAP}
    SELECT t.id, round((2.0::DOUBLE * coalesce(ov, 0)::DOUBLE / (len(pt) + len(rt)) + 2.0 * prow[len(rt) + 1] / (len(pt) + len(rt))) / 2, 6) AS overlap
    FROM steps s JOIN tok t ON s.id = t.id AND s.i = len(t.pt) LEFT JOIN ov ON ov.id = t.id""")
def answer_overlap(spark, d):
    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("output"))
    rows = b.join(nxt, "item_id").select(F.col("item_id").alias("id"), X.words(F.col("text")).alias("p"), X.words(F.col("output")).alias("r"))
    return rows.select("id", F.round((M.rouge1(F.col("p"), F.col("r")) + M.rouge_l(F.col("p"), F.col("r"))) / 2, 6).alias("overlap"))


@query("judged_rollup", f"""WITH RECURSIVE {BENCH}, {LCS}, {OVERLAP}, s AS (
      SELECT 'g' || (t.id % 3) AS grp, 2.0::DOUBLE * coalesce(ov, 0)::DOUBLE / (len(pt) + len(rt)) AS r1, 2.0::DOUBLE * prow[len(rt) + 1] / (len(pt) + len(rt)) AS rl, l.quality::DOUBLE AS judge
      FROM steps s JOIN tok t ON s.id = t.id AND s.i = len(t.pt) LEFT JOIN ov ON ov.id = t.id LEFT JOIN labels l ON l.doc_id = t.id),
    g AS (SELECT grp, count(*) AS n, avg(r1) AS r1, avg(rl) AS rl, avg(judge) AS judge, count(judge) AS judge_n FROM s GROUP BY grp),
    a AS (SELECT 'ALL' AS grp, sum(n)::BIGINT AS n, sum(r1 * n) / sum(n) AS r1, sum(rl * n) / sum(n) AS rl, sum(judge * n) FILTER (judge_n > 0) / sum(n) FILTER (judge_n > 0) AS judge, sum(judge_n)::BIGINT AS judge_n FROM g)
    SELECT grp AS subset, n, round(r1, 6) AS rouge1, round(rl, 6) AS "rougeL", round(judge, 6) AS judge, judge_n, round(0.37::DOUBLE * r1 + 0.37::DOUBLE * rl, 6) AS rouge_only, round(0.37::DOUBLE * r1 + 0.37::DOUBLE * rl + 0.26::DOUBLE * judge, 6) AS total
    FROM (SELECT * FROM g UNION ALL SELECT * FROM a)""")
def judged_rollup(spark, d):
    """Both ROUGE scores, a judge that has seen some of the rows, and the totals by group; ALL's judge by the groups' sizes."""
    from askloom.operators import reports as T

    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("output"))
    p, r = X.words(F.col("text")), X.words(F.col("output"))
    rows = b.join(nxt, "item_id").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("g"), F.col("item_id") % 3).alias("subset"), M.rouge1(p, r).alias("r1"), M.rouge_l(p, r).alias("rl"))
    judged = rows.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("judge")), "doc_id", "left")
    return T.full_report(judged, "subset", "judge", 6)


@query("tokenizer_compare", rf"""SELECT lang, sum(len({words_sql('text')}))::BIGINT AS n_blank, sum(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')))::BIGINT AS n_unicode,
    sum(len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')))::BIGINT AS n_ascii, sum(len(regexp_extract_all(text, '[^\s?.,!]+')))::BIGINT AS n_plain FROM documents GROUP BY lang""")
def tokenizer_compare(spark, d):
    t = F.col("text")
    count = lambda c, n: F.sum(F.size(c)).alias(n)
    return table(spark, d, "documents").groupBy("lang").agg(count(X.words(t), "n_blank"), count(X.words_unicode(t), "n_unicode"), count(X.words_ascii(t), "n_ascii"), count(X.words_plain(t), "n_plain"))


_NEAR = " AND ".join(f"a[i + {k}] = a[i + 1]" for k in range(2, 9))


@query("loop_detector", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS a FROM documents)
    SELECT doc_id, len(list_filter(range(1, len(a) - 8), lambda i: {_NEAR} AND suffix(a[i], a[i + 1]) AND starts_with(a[i + 9], a[i + 1]))) > 0 AS loops FROM w""")
def loop_detector(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_loop(F.col("text")).alias("loops"))


@query("sentence_split")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("clean_text", r"SELECT doc_id, regexp_replace(text, '[\r\n\x{2028}\x{2029}]+', ' ', 'g') AS flat, length(text) AS n FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.flatten_lines(F.col("text")).alias("flat"), F.length("text").cast("long").alias("n"))


@query("postprocess", rf"WITH {QA} SELECT id, trim(string_split(trim(output), chr(10) || chr(10))[1]) AS first, array_to_string({words_sql('output')}, ' ') AS joined FROM qa")
def postprocess(spark, d):
    return qa_pool(spark, d).select("id", X.postprocess(F.col("output")).alias("first"), X.postprocess(F.col("output"), join=True).alias("joined"))


@query("refusal_rate", f"WITH {QA} SELECT subset, round(avg((length(trim(output)) < 5 OR contains(lower(output), 'i cannot') OR contains(lower(output), 'i can''t') OR contains(lower(output), 'as an ai') OR contains(lower(output), 'i''m sorry') OR contains(lower(output), 'consult a doctor'))::INT), 6) AS refusals FROM qa GROUP BY subset")
def refusal_rate(spark, d):
    return qa_pool(spark, d).groupBy("subset").agg(F.round(F.avg(X.is_refusal(F.col("output")).cast("int")), 6).alias("refusals"))


@query("script_quarantine", r"SELECT doc_id, regexp_matches(text, '[\x{1200}-\x{137F}]') AS geez, lang = 'amh' AND NOT regexp_matches(text, '[\x{1200}-\x{137F}]') AS quarantined FROM documents")
def script_quarantine(spark, d):
    geez = F.col("text").rlike(X.GEEZ)
    return table(spark, d, "documents").select("doc_id", geez.alias("geez"), ((F.col("lang") == "amh") & ~geez).alias("quarantined"))


_LANG = lambda ms: " + ".join(f"contains(low, ' {m} ')::INT" for m in ms)


@query("lang_heuristic", f"""WITH l AS (SELECT doc_id, lang, ' ' || lower(text) || ' ' AS low FROM documents),
    s AS (SELECT doc_id, lang, [({_LANG(('the', 'of', 'and', 'to', 'is'))}), ({_LANG(('le', 'la', 'de', 'et', 'que'))}), ({_LANG(('der', 'die', 'und', 'ein', 'nicht'))}), ({_LANG(('el', 'los', 'que', 'por', 'del'))})] AS n FROM l)
    SELECT doc_id, lang, CASE WHEN list_max(n) = 0 THEN 'und' WHEN n[2] = list_max(n) THEN 'fr' WHEN n[4] = list_max(n) THEN 'es' WHEN n[1] = list_max(n) THEN 'en' ELSE 'de' END AS guess FROM s""")
def lang_heuristic(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", X.language(F.col("text")).alias("guess"))


@query("language_confusion")
def language_confusion(spark, d):
    """Languages found by a model of nine tenths of the documents in the last tenth. Fitted tables of hashes: no SQL."""
    from askloom.operators import language as N

    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    return N.confusion(N.detect(docs.where(held), N.fit(docs.where(~held))))


JUDGED = "CASE doc_id % 6 WHEN 0 THEN '{\"overall\": ' || (quality + 3) || '}' WHEN 1 THEN '{\"accuracy\": 4, \"completeness\": 3, \"language\": 4}' WHEN 2 THEN 'Score: ' || (quality + 1) WHEN 3 THEN (quality + 4) || '/5' WHEN 4 THEN 'I would say 3' ELSE 'between 2 and 4' END"


@query("judge_parse", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN quality + 3.0 WHEN 1 THEN round(11.0 / 3, 6) WHEN 2 THEN quality + 1.0 WHEN 3 THEN quality + 4.0 WHEN 4 THEN 3.0 END::DOUBLE AS score FROM labels")
def judge_parse(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round(X.judge_score(F.expr(JUDGED)), 6).alias("score"))


@query("subset_from_id", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' ELSE 'Aka_Gha' END AS subset FROM documents")
def subset_from_id(spark, d):
    row_id = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ID_"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("ID_TR_Aka_Gha_"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", X.subset_of(row_id).alias("subset"))


@query("text_digest", "SELECT doc_id, sha1(text) AS sha1, substr(sha256('askloom|' || text), 1, 12) AS run_key, length(text) AS n_chars_, left(text, 80) AS head FROM documents")
def text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.substring(F.sha2(F.concat(F.lit("askloom|"), F.col("text")), 256), 1, 12).alias("run_key"), F.length("text").cast("long").alias("n_chars_"), F.substring("text", 1, 80).alias("head"))


@query("candidate_text", f"WITH {QA} SELECT id, input AS question, left(output, 200) AS answer, input || ' || ' || left(output, 200) AS both FROM qa")
def candidate_text(spark, d):
    a = F.substring("output", 1, 200)
    return qa_pool(spark, d).select("id", F.col("input").alias("question"), a.alias("answer"), F.concat_ws(" || ", "input", a).alias("both"))


@query("bert_score_vectors")
def bert_score_vectors(spark, d):
    """BERTScore shape: token vectors are groups of four embeddings, predictions group i, references group i + 1."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("g"), "vec_id", "embedding")
    held = e.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    both = held.join(held.select((F.col("g") - 1).alias("g"), F.col("v").alias("r")), "g")
    return both.select("g", M.bert_score(F.col("v"), F.col("r")).alias("s")).select("g", F.round("s.precision", 5).alias("precision"), F.round("s.recall", 5).alias("recall"), F.round("s.f1", 5).alias("f1"))
