"""Queries of roles, languages, left joins, run records and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import prompts as P
from askloom.functions import text as X
from askloom.operators import frames as D
from askloom.operators import reports as T
from askloom.operators.splits import ordinal
from askloom.plans.common import OVERLAP, PREV, QA, previous_answers, qa_pool, table, words_sql
from askloom.plans.retrieval_queries import SELF, neighbours

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("role_columns", f"WITH {QA} SELECT id, input AS question, output AS answer, subset AS language FROM qa")
def role_columns(spark, d):
    """Roles from three schemas of which the last has no answers."""
    rows = qa_pool(spark, d).select("id", "input", "output", "subset")
    roles = D.detect_roles(rows.columns, rows.columns, D.hidden(rows, "output").columns)
    return D.by_roles(rows, roles)


@query("canonical_names", f'WITH {QA} SELECT id, input AS "Question", output AS "Response", subset AS "Language" FROM qa')
def canonical_names(spark, d):
    return D.canonical(qa_pool(spark, d).select("id", "input", "output", "subset"))


_NAMES = "['Swahili (Kenya)', 'lug', 'Akan', 'AMH', 'english uk', 'Tongan']"


@query("language_codes", f"""WITH n AS (SELECT doc_id, {_NAMES}[doc_id % 6 + 1] AS raw FROM documents) SELECT doc_id, raw, CASE WHEN starts_with(lower(raw), 'swa') OR contains(lower(raw), 'swahili') THEN 'swa' WHEN starts_with(lower(raw), 'lug') THEN 'lug' WHEN starts_with(lower(raw), 'aka') THEN 'aka' WHEN starts_with(lower(raw), 'amh') THEN 'amh' WHEN starts_with(lower(raw), 'eng') THEN 'eng' END AS code FROM n""")
def language_codes(spark, d):
    names = F.array(*[F.lit(x) for x in ("Swahili (Kenya)", "lug", "Akan", "AMH", "english uk", "Tongan")])
    raw = F.get(names, (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"), D.language_code(raw).alias("code"))


@query("code_lookup", "SELECT doc_id, CASE source WHEN 'src0' THEN 'web' WHEN 'src1' THEN 'books' ELSE source END AS kind, CASE lang WHEN 'fr' THEN 'fra' ELSE 'eng' END AS code FROM documents")
def code_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", D.looked_up(F.col("source"), {"src0": "web", "src1": "books"}).alias("kind"), D.looked_up(F.col("lang"), {"fr": "fra"}, "eng").alias("code"))


@query("left_fill", "SELECT d.doc_id, coalesce(l.quality, 0)::INT AS quality, 0.0::DOUBLE AS absent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_fill(spark, d):
    """Missing matches become the fill value, and so does a column that the right side lacks."""
    return D.left_filled(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", {"quality": 0, "absent": 0.0}).select("doc_id", F.col("quality").cast("int").alias("quality"), "absent")


@query("left_candidates", f"WITH {QA} SELECT a.id, a.output AS base, coalesce(b.output, '') AS generated FROM qa a LEFT JOIN qa b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2")
def left_candidates(spark, d):
    """The base's rows with generated ones where there are any, else an empty text."""
    rows = qa_pool(spark, d)
    made = rows.select(F.concat("conv_id", F.lit(":"), F.col("turn") - 2).alias("k"), F.col("output").alias("generated"))
    return D.left_filled(rows.withColumn("k", F.concat("conv_id", F.lit(":"), "turn")), made, "k", {"generated": ""}).select("id", F.col("output").alias("base"), "generated")


@query("left_required", "SELECT l.doc_id, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def left_required(spark, d):
    """Every label has its document; a missing one would end the query with an error."""
    return D.left_required(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents"), "doc_id", ["lang"])


@query("count_table", "SELECT lang, count(*) FILTER (k < 6) AS train, count(*) FILTER (k IN (6, 7)) AS test, count(*) FILTER (k > 7) AS val FROM (SELECT lang, doc_id % 10 AS k FROM documents) GROUP BY lang HAVING count(*) FILTER (k < 6) > 0")
def count_table(spark, d):
    """Rows of three parts by language."""
    rows = table(spark, d, "documents").withColumn("k", F.col("doc_id") % 10)
    return D.counts_table({"train": rows.where("k < 6"), "test": rows.where("k in (6, 7)"), "val": rows.where("k > 7")}, "lang")


@query("named_sets", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'oof' END AS set, count(*) FILTER (doc_id % 4 IN (0, 1)) AS queries, count(*) AS rows FROM documents GROUP BY 1")
def named_sets(spark, d):
    """Queries and pools of two sets as tables with a set column; here their sizes."""
    rows = table(spark, d, "documents").select("doc_id")
    of = lambda c: rows.where(c)
    queries, pools = D.named_sets({"val": (of("doc_id % 4 = 0"), of("doc_id % 4 = 0")), "oof": (of("doc_id % 4 = 1"), of("doc_id % 4 <> 0"))})
    return pools.groupBy("set").agg(F.count("*").alias("rows")).join(queries.groupBy("set").agg(F.count("*").alias("queries")), "set")


@query("resume_pending", "SELECT e.event_id FROM events e WHERE e.event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def resume_pending(spark, d):
    """What is left to do after answers came, some of them twice."""
    e = table(spark, d, "events").select("event_id")
    done = e.where("event_id % 3 = 0")
    return D.pending(e, done.unionByName(done), "event_id")


_RUNS = "r AS (SELECT 'u' || user_id AS parent, 'r' || event_id AS run, ts AS finished, event_type AS subset FROM events)"


@query("newest_child", f"WITH {_RUNS} SELECT parent, max_by(run, struct_pack(a := finished, b := run)) AS run FROM r GROUP BY parent")
def newest_child(spark, d):
    e = table(spark, d, "events")
    return D.newest_child(e.select(F.concat(F.lit("u"), "user_id").alias("parent"), F.concat(F.lit("r"), "event_id").alias("run"), F.col("ts").alias("finished")))


@query("composite_sources", """WITH p AS (SELECT DISTINCT 'r' || (user_id % 7) AS run, event_type AS subset FROM events), c AS (SELECT DISTINCT event_type AS subset, 'r' || (length(event_type) + 3) AS best FROM events),
    k AS (SELECT 'r' || (i % 5 + 5) AS parent, 'r' || i AS run, i AS finished FROM range(12) t(i)),
    own AS (SELECT c.subset, best AS run, 1 AS first, NULL AS finished FROM c JOIN p ON p.run = best AND p.subset = c.subset),
    kid AS (SELECT c.subset, k.run, 0, k.finished FROM c JOIN k ON k.parent = c.best JOIN p ON p.run = k.run AND p.subset = c.subset)
    SELECT c.subset, n.run FROM c LEFT JOIN (SELECT subset, run FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY first DESC, finished DESC NULLS LAST, run DESC) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM kid)) WHERE n = 1) n ON n.subset = c.subset""")
def composite_sources(spark, d):
    """Which run's predictions each subset takes."""
    e = table(spark, d, "events")
    preds = e.select(F.concat(F.lit("r"), F.col("user_id") % 7).alias("run"), F.col("event_type").alias("subset"))
    best = e.select(F.col("event_type").alias("subset"), F.concat(F.lit("r"), F.length("event_type") + 3).alias("run")).distinct()
    kids = spark.range(12).select(F.concat(F.lit("r"), F.col("id") % 5 + 5).alias("parent"), F.concat(F.lit("r"), "id").alias("run"), F.col("id").alias("finished"))
    return D.composite(best, preds, kids)


@query("run_status", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'crash' WHEN value > 90 AND event_id % 3 < 2 THEN 'timeout' WHEN event_id % 3 < 2 THEN 'incomplete' ELSE 'ok' END AS status FROM events")
def run_status(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("answered"), F.lit(2).alias("wanted"), F.col("value").alias("seconds"), F.when(F.col("event_type") == "error", F.lit("x")).alias("error"))
    return D.run_status(e, limit=90.0).select("event_id", "status")


@query("champion_shares", "SELECT lang, round(count(*) / sum(count(*)) OVER (), 6) AS share, mode_source FROM (SELECT lang, max(source) OVER (PARTITION BY lang) AS mode_source FROM documents) GROUP BY lang, mode_source ORDER BY share DESC, lang")
def champion_shares(spark, d):
    """Languages by share of all rows, the largest first."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("source").alias("mode_source"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("lang", F.round(F.col("n") / F.col("total"), 6).alias("share"), "mode_source").orderBy(F.desc("share"), "lang")  # total is one row


@query("frequent_champion", "SELECT source AS run FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 1")
def frequent_champion(spark, d):
    """The run that is champion most often; the first name of equals."""
    n = table(spark, d, "documents").groupBy(F.col("source").alias("run")).agg(F.count("*").alias("n"))
    return n.agg(F.min_by("run", F.struct(-F.col("n"), F.col("run"))).alias("run"))


@query("row_order", f"WITH {QA} SELECT id, row_number() OVER (ORDER BY id) AS n FROM qa QUALIFY true")
def row_order(spark, d):
    """Splits are put together again in the order of the rows they came from: ranks by blocks and offsets, no single task."""
    rows = qa_pool(spark, d).select("id", F.substring("id", 1, 7).alias("block"), F.lit(0).alias("whole"))
    return ordinal(rows, "whole", F.col("block"), [F.col("id")]).select("id", F.col("rn").alias("n"))


_DETECT = "d AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS found, (doc_id % 11) / 10.0::DOUBLE AS conf FROM documents)"


@query("language_check", f"WITH {_DETECT} SELECT doc_id, found = lang OR (conf < 0.4 AND length(text) < 30) AS ok, found <> lang AND conf > 0.6 AS mismatch FROM d")
def language_check(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("found"), ((F.col("doc_id") % 11) / 10).alias("conf"))
    found, lang, conf = F.col("found"), F.col("lang"), F.col("conf")
    return rows.select("doc_id", T.language_ok(found, lang, conf, F.col("text")).alias("ok"), T.language_mismatch(found, lang, conf).alias("mismatch"))


@query("mismatch_rate", f"WITH {_DETECT} SELECT lang, round(avg((found <> lang AND conf > 0.6)::INT), 6) AS rate FROM d GROUP BY lang")
def mismatch_rate(spark, d):
    rows = language_check(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg(F.col("mismatch").cast("int")), 6).alias("rate"))


@query("mean_similarity", f"WITH {SELF} SELECT label, round(avg(sim), 6) AS sim, count(*) AS n FROM self WHERE rank = 1 GROUP BY label")
def mean_similarity(spark, d):
    return neighbours(spark, d, 1).groupBy("label").agg(F.round(F.avg("sim"), 6).alias("sim"), F.count("*").alias("n"))


_Q = lambda p, c: f"quantile_cont({c}, {p})"


@query("length_bounds_reconciled", f"""WITH n AS (SELECT lang, doc_id % 4 = 0 AS val, n_chars AS k FROM documents), t AS (SELECT lang, floor({_Q(0.1, 'k')}) AS t10, floor({_Q(0.9, 'k')}) AS t90 FROM n WHERE NOT val GROUP BY lang), v AS (SELECT lang, floor({_Q(0.1, 'k')}) AS v10, floor({_Q(0.9, 'k')}) AS v90 FROM n WHERE val GROUP BY lang),
    b AS (SELECT t.lang, coalesce(abs(v90 - t90) > 20, false) AS averaged, t10, t90, v10, v90 FROM t LEFT JOIN v ON v.lang = t.lang)
    SELECT lang, greatest(1, floor(CASE WHEN averaged THEN round_even((t10 + v10) / 2, 0) ELSE t10 END * 0.8))::BIGINT AS low, (CASE WHEN averaged THEN round_even((t90 + v90) / 2, 0) ELSE t90 END + 30)::BIGINT AS high, averaged FROM b""")
def length_bounds_reconciled(spark, d):
    rows = table(spark, d, "documents").select("lang", F.col("n_chars").alias("k"), (F.col("doc_id") % 4 == 0).alias("val"))
    ends = lambda x: x.groupBy("lang").agg(F.percentile("k", 0.1).alias("p10"), F.percentile("k", 0.9).alias("p90"))
    return T.reconciled_bounds(ends(rows.where("not val")), ends(rows.where("val")), "lang")


@query("token_audit", f"""WITH t AS (SELECT lang, m, text, CASE m WHEN 'blank' THEN len({words_sql('text')}) ELSE length(text) // 4 END AS n FROM documents, (VALUES ('blank'), ('quarter')) x(m)), o AS (SELECT *, length(text) / n::DOUBLE AS cpt FROM t WHERE n > 0)
    SELECT lang, m AS model, count(*) AS n, round({_Q(0.5, 'cpt')}, 6) AS cpt_p50, round({_Q(0.05, 'cpt')}, 6) AS cpt_p05, {_Q(0.5, 'n')} AS tokens_p50, round({_Q(0.95, 'n')}, 6) AS tokens_p95, max(n)::BIGINT AS tokens_max FROM o GROUP BY ALL""")
def token_audit(spark, d):
    """Two tokenizers: blanks, and four characters a token."""
    rows = table(spark, d, "documents")
    n = lambda m, c: rows.select("lang", "text", F.lit(m).alias("model"), c.cast("long").alias("tokens"))
    both = n("blank", F.size(X.words(F.col("text")))).unionByName(n("quarter", F.floor(F.length("text") / 4)))
    out = T.token_audit(both, ["lang", "model"], "text", "tokens")
    return out.withColumns({c: F.round(c, 6) for c in ("cpt_p50", "cpt_p05", "tokens_p95")})


_JUDGED = f"""tok AS (SELECT id, subset, {words_sql('pred')} AS pt, {words_sql('output')} AS rt FROM prev), {OVERLAP}"""


@query("full_report")
def full_report(spark, d):
    """ROUGE-1, ROUGE-L, a judge's score and the total by subset with an ALL row."""
    p, r = X.words(F.col("pred")), X.words(F.col("output"))
    rows = previous_answers(spark, d).select("conv_id", "subset", M.rouge1(p, r).alias("r1"), M.rouge_l(p, r).alias("rl"))
    judged = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.col("quality").cast("double").alias("judge")), "conv_id", "left")
    return T.full_report(judged, "subset", "judge")


_ROLL = "count(*) AS n, round(avg(x), 6) AS score"


@query("tokenizer_columns")
def tokenizer_columns(spark, d):
    """The weighted ROUGE of copying the answer before under four tokenizers, a column each, by subset with an ALL row. The
    fourth stems its tokens, for which there is no SQL."""
    return T.compare_tokenizers(previous_answers(spark, d), "subset", "pred", "output")


@query("tokenizer_scores", f"""WITH {PREV}, w(m) AS (VALUES ('blank'), ('ascii'), ('plain')), t AS (SELECT id, subset, m, CASE m WHEN 'blank' THEN {words_sql('pred')} WHEN 'ascii' THEN regexp_extract_all(lower(pred), '[a-z0-9]+') ELSE regexp_extract_all(pred, '[^ \\t\\n\\x0B\\f\\r?.,!]+') END AS pt,
      CASE m WHEN 'blank' THEN {words_sql('output')} WHEN 'ascii' THEN regexp_extract_all(lower(output), '[a-z0-9]+') ELSE regexp_extract_all(output, '[^ \\t\\n\\x0B\\f\\r?.,!]+') END AS rt FROM prev, w),
    o AS (SELECT id, m, sum(least(a, b)) AS ov FROM (SELECT id, m, x, count(*) FILTER (s = 'p') AS a, count(*) FILTER (s = 'r') AS b FROM (SELECT id, m, unnest(pt) AS x, 'p' AS s FROM t UNION ALL SELECT id, m, unnest(rt), 'r' FROM t) GROUP BY ALL) GROUP BY ALL),
    f AS (SELECT t.subset, t.m, CASE WHEN len(pt) > 0 AND len(rt) > 0 THEN 2.0::DOUBLE * coalesce(ov, 0)::DOUBLE / (len(pt) + len(rt)) ELSE 0.0 END AS x FROM t LEFT JOIN o ON o.id = t.id AND o.m = t.m)
    SELECT coalesce(subset, 'ALL') AS subset, m AS tokenizer, {_ROLL} FROM f GROUP BY GROUPING SETS ((subset, m), (m))""")
def tokenizer_scores(spark, d):
    """The same score under three tokenizers, by subset with an ALL row."""
    rows, made = previous_answers(spark, d), None
    for name, cut in (("blank", X.words), ("ascii", X.words_ascii), ("plain", X.words_plain)):
        scored = rows.select("subset", M.rouge1(cut(F.col("pred")), cut(F.col("output"))).alias("x"))
        part = T.with_all(scored, "subset", F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("score")).withColumn("tokenizer", F.lit(name))
        made = part if made is None else made.unionByName(part)
    return made


@query("weakest_measure", "SELECT lang, CASE WHEN a <= b AND a <= c THEN 'a' WHEN b <= c THEN 'b' ELSE 'c' END AS measure, least(a, b, c) AS value FROM (SELECT lang, round(avg(n_chars % 7), 6) AS a, round(avg(n_chars % 5), 6) AS b, round(avg(doc_id % 6), 6) AS c FROM documents GROUP BY lang)")
def weakest_measure(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(F.col("n_chars") % 7), 6).alias("a"), F.round(F.avg(F.col("n_chars") % 5), 6).alias("b"), F.round(F.avg(F.col("doc_id") % 6), 6).alias("c"))
    return T.weakest(rows, "lang", ["a", "b", "c"])


@query("recommended_entries", """WITH e AS (SELECT source AS name, round(avg(n_chars % 10) / 10, 6) AS public, round(avg(doc_id % 9) / 10, 6) AS combined, CASE WHEN source <> 'src1' THEN round((max(doc_id % 4) - min(doc_id % 3)) / 10.0::DOUBLE, 6) END AS gap FROM documents GROUP BY source)
    SELECT (SELECT name FROM e ORDER BY public DESC, name LIMIT 1) AS best_public, (SELECT name FROM e ORDER BY round(combined - 0.5::DOUBLE * coalesce(gap, 0), 9) DESC, name LIMIT 1) AS best_robust, (SELECT max(round(combined - 0.5::DOUBLE * coalesce(gap, 0), 9)) FROM e) AS robust""")
def recommended_entries(spark, d):
    e = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.round(F.avg(F.col("n_chars") % 10) / 10, 6).alias("public"), F.round(F.avg(F.col("doc_id") % 9) / 10, 6).alias("combined"), F.round((F.max(F.col("doc_id") % 4) - F.min(F.col("doc_id") % 3)) / 10, 6).alias("gap"))
    return T.recommend(e.withColumn("gap", F.when(F.col("name") != "src1", F.col("gap"))))


@query("calibration")
def calibration(spark, d):
    """Perfect and wrong-language predictions of a sample that a hash picks: ROUGE-1 and ROUGE-L by the proxy's weights."""
    rows = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    picked = rows.where(F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(50)) == 0)
    both = T.wrong_language(rows, "doc_id", "lang", "text", picked)
    score = lambda a: (M.rouge1(X.words(F.col(a)), X.words(F.col("text"))) + M.rouge_l(X.words(F.col(a)), X.words(F.col("text")))) / 2
    return T.calibration(both.select(score("text").alias("perfect"), score("other").alias("wrong")))


@query("sampled_negatives", f"WITH {SELF} SELECT q, p FROM (SELECT q, p, row_number() OVER (PARTITION BY q ORDER BY md5('5|' || q || '|' || p), p) AS n FROM self WHERE rank <= 3) WHERE n <= 1")
def sampled_negatives(spark, d):
    return T.sampled_negatives(neighbours(spark, d), 1, 5).select("q", "p")


@query("option_floor", f"WITH {SELF}, o AS (SELECT q, list(sim ORDER BY rank) AS sims FROM self GROUP BY q) SELECT q, list_max(sims) AS best FROM o WHERE list_max(sims) >= 0.3")
def option_floor(spark, d):
    """Questions whose best option reaches the floor; the others are no training rows."""
    rows = neighbours(spark, d).groupBy("q").agg(F.collect_list("sim").alias("sims"))
    return rows.select("q", F.array_max("sims").alias("best")).where("best >= 0.3")


@query("candidate_union", f"WITH {SELF}, c AS (SELECT q, p FROM self WHERE rank <= 2 UNION SELECT p, q FROM self WHERE rank = 1) SELECT q, list(p ORDER BY p) AS candidates FROM c GROUP BY q")
def candidate_union(spark, d):
    """Candidates of two rankers together, each once, in order."""
    n = neighbours(spark, d)
    both = n.where("rank <= 2").select("q", "p").unionByName(n.where("rank = 1").select(F.col("p").alias("q"), F.col("q").alias("p")))
    return both.groupBy("q").agg(F.sort_array(F.collect_set("p")).alias("candidates"))


@query("legacy_judge", f"""WITH {QA}, j AS (SELECT id, CASE WHEN turn % 4 = 0 THEN 'so {{"accuracy": ' || (conv_id % 5 + 1) || ', "language": 3, "completeness": 2}} end' ELSE 'none' END AS t FROM qa) SELECT id, CASE WHEN t = 'none' THEN 0.5::DOUBLE ELSE round((regexp_extract(t, 'accuracy": (\\d+)', 1)::DOUBLE + 5) / 15, 6) END AS score FROM j""")
def legacy_judge(spark, d):
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('so {"accuracy": '), F.col("conv_id") % 5 + 1, F.lit(', "language": 3, "completeness": 2} end'))).otherwise("none")
    return qa_pool(spark, d).select("id", F.round(P.legacy_judge(said), 6).alias("score"))


@query("scored_pairs_parse", "SELECT user_id, string_agg(event_id || ':x:' || round(value, 2), ',' ORDER BY event_id) AS text, list('' || event_id || ':x' ORDER BY event_id) AS ids, list(round(value, 2) ORDER BY event_id) AS scores FROM events GROUP BY user_id")
def scored_pairs_parse(spark, d):
    """id:score lists, cut at the last colon: ids may hold colons themselves."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.round("value", 2).alias("v")))), lambda x: F.concat(x["event_id"], F.lit(":x:"), x["v"].cast("string")))
    rows = table(spark, d, "events").groupBy("user_id").agg(items.alias("items"))
    cut = lambda x: F.struct(F.regexp_extract(x, "^(.*):([^:]*)$", 1).alias("id"), F.regexp_extract(x, "^(.*):([^:]*)$", 2).cast("double").alias("score"))
    parsed = rows.select("user_id", F.array_join("items", ",").alias("text")).withColumn("x", F.transform(F.split("text", ","), cut))
    return parsed.select("user_id", "text", F.col("x.id").alias("ids"), F.col("x.score").alias("scores"))


@query("sentence_pairs")
def sentence_pairs(spark, d):
    """Question and answer as pairs of sentences in both directions; sentences are cut by look-behind, which SQL lacks here."""
    rows = qa_pool(spark, d).select("id", F.explode(T.sentence_pairs(F.col("input"), F.col("output"))).alias("x"))
    return rows.select("id", "x.source", "x.target")


@query("sentence_map")
def sentence_map(spark, d):
    return qa_pool(spark, d).select("id", T.by_sentence(F.col("output"), F.upper).alias("text"))


@query("same_hash", "SELECT true AS reordered, (SELECT count(*) = 0 FROM documents WHERE lang = 'en') AS one_more, (SELECT count(*) = 0 FROM labels WHERE quality = 1) AS changed")
def same_hash(spark, d):
    """Fingerprints of the same rows in another order, of rows of which some occur twice, and of rows with a column emptied."""
    rows, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang")
    made = D.same_hash(rows, rows.orderBy(F.desc("doc_id")), rows.columns).select(F.col("equal").alias("reordered"))
    more = D.same_hash(docs, docs.unionByName(docs.where("lang = 'en'")), docs.columns).select(F.col("equal").alias("one_more"))
    other = D.same_hash(rows, rows.withColumn("quality", F.when(F.col("quality") != 1, F.col("quality"))), rows.columns).select(F.col("equal").alias("changed"))
    return made.crossJoin(more).crossJoin(other)  # one row each


@query("proxy_total", "SELECT doc_id, round(0.3125::DOUBLE * (doc_id % 5) / 5 + 0.3125::DOUBLE * (doc_id % 3) / 3 + 0.375::DOUBLE * (doc_id % 2), 6) AS total FROM documents")
def proxy_total(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(M.proxy((F.col("doc_id") % 5) / 5, (F.col("doc_id") % 3) / 3, F.col("doc_id") % 2), 6).alias("total"))



@query("cross_fitted_lists", f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 3 AS fold FROM embeddings), s AS (SELECT a.vec_id AS q, a.fold, b.vec_id AS p, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS sim FROM v a JOIN v b ON a.label = b.label AND a.fold <> b.fold)
    SELECT fold, q, string_agg(p || ':' || printf('%.6f', sim), '|' ORDER BY rank) AS list FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS rank FROM s) WHERE rank <= 3 GROUP BY fold, q""")
def cross_fitted_lists(spark, d):
    """Each fold's candidates come from the rows of the other folds only."""
    from askloom.operators import retrieval as R

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"), (F.col("vec_id") % 3).alias("fold"))
    found = R.dense_top_k(v, v, 3, "label", differ="fold")
    items = F.transform(F.sort_array(F.collect_list(F.struct("rank", "p", "sim"))), lambda x: F.concat_ws(":", x["p"], F.format_string("%.6f", x["sim"])))
    return found.groupBy((F.col("q") % 3).alias("fold"), "q").agg(F.array_join(items, "|").alias("list"))
