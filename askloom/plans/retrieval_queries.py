"""Queries of similarity joins, votes, routes and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.functions import metrics as M
from askloom.functions import text as X
from askloom.operators import matching as A
from askloom.operators import retrieval as R
from askloom.operators import selection as S
from askloom.plans.common import QA, qa_pool, table, words_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def weighted(spark, d, grams, min_df=1, make=R.tfidf):
    """Weights (id, subset, term, w) of the questions, fitted on the whole pool; or what `make` makes of counts and idf."""
    pool = qa_pool(spark, d).select("id", "subset", "input")
    counts = R.hashed_counts(pool, ["id", "subset"], grams(F.col("input")))
    return make(counts, R.idf(counts, pool.agg(F.count("*").alias("n")), min_df), ["id", "subset"])


def lexical(spark, d, grams, min_df=1, k=3):
    """Similarities of questions (q) to all others (p) of the same subset."""
    return listed(question_files(spark, d, grams, min_df), k)


def question_files(spark, d, grams, min_df=1):
    return R.tfidf_files(qa_pool(spark, d).select("id", "subset", "input"), "subset", grams(F.col("input")), min_df)


def listed(held, k=3):
    return R.sparse_top_k(held, held, k, "subset", drop_self=True).select("q", "p", "sim", F.col("rank").cast("long").alias("rank"))


def lexical_sql(grams: str, min_df: int, k: int = 3, meet: str = "a.subset = b.subset") -> str:
    return f"""WITH {QA}, tf AS (SELECT id, subset, term, count(*) AS tf FROM (SELECT id, subset, unnest({grams}) AS term FROM qa) GROUP BY ALL),
    df AS (SELECT term, ln((1 + (SELECT count(*) FROM qa)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= {min_df}),
    raw AS (SELECT id, subset, tf.term, (1 + ln(tf)) * idf AS w FROM tf JOIN df ON tf.term = df.term),
    v AS (SELECT id, subset, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
    s AS (SELECT a.id AS q, b.id AS p, round(sum(a.w * b.w), 6) AS sim FROM v a JOIN v b ON {meet} AND a.term = b.term AND a.id <> b.id GROUP BY 1, 2)
    SELECT * FROM (SELECT q, p, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS rank FROM s) WHERE rank <= {k}"""


_PLAIN = r"regexp_extract_all(lower(input), '[^\s?.,!]+')"
_CHARS = (
    "flatten(list_transform(" + words_sql("lower(input)") + ", lambda w: flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(w) + 2 > n THEN "
    "list_transform(range(1, length(w) + 2 - n + 2), lambda i: substr(' ' || w || ' ', i, n)) WHEN length(w) + 2 = n OR n = 3 THEN [' ' || w || ' '] ELSE [] END))))"
)


@query("word_tfidf_topk", lexical_sql(_PLAIN, 1))
def word_tfidf(spark, d):
    return lexical(spark, d, lambda c: X.words_plain(F.lower(c)))


@query("char_tfidf_topk", lexical_sql(_CHARS, 2))
def char_tfidf(spark, d):
    return lexical(spark, d, X.char_ngrams, 2)


@query("pairs_scored", f"WITH {QA}, n AS (SELECT subset, count(*) AS n FROM qa GROUP BY subset) SELECT subset, (n * n)::BIGINT AS n_pairs, true AS few FROM n")
def pairs_scored(spark, d):
    """Pairs of questions by subset, and whether the bounds of char_tfidf_topk leave at most a tenth of them to be added up."""
    held = weighted(spark, d, X.char_ngrams, 2, R.unit_vectors)
    out = R.pairs_scored(held, held, 3, "subset", drop_self=True)
    return out.select("subset", "n_pairs", (10 * F.col("n_scored") <= F.col("n_pairs")).alias("few"))


@query("bm25_topk", f"""WITH t AS (SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest({words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
    l AS (SELECT id, sum(tf) AS len FROM t GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS avg FROM l), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    s AS (SELECT q.id AS q, p.id AS p, round(sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score
      FROM t q JOIN t p ON q.term = p.term AND q.id <> p.id JOIN l ON l.id = p.id JOIN df ON df.term = p.term CROSS JOIN st GROUP BY q.id, p.id)
    SELECT q, p, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p) AS rank FROM s) WHERE rank <= 5""")
def bm25_topk(spark, d):
    """For every item against all others; an item does not match itself."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("within"), "text")
    counts = R.term_counts(items, ["id", "within"], X.words(F.col("text")))
    asked = counts.select("id", "within", "term", F.col("tf").cast("double").alias("w"))
    found = R.sparse_top_k(asked, R.bm25_weights(counts, "within"), 5, "within", drop_self=True)
    return found.select("q", "p", F.col("sim").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bow_neardup", rf"""WITH {QA}, a AS (SELECT min(id) AS id, output, count(*) AS freq FROM qa GROUP BY output),
    t AS (SELECT id, freq, term, count(*)::DOUBLE AS tf FROM (SELECT id, freq, unnest(regexp_extract_all(output, '[^\s?.,!]+')) AS term FROM a) GROUP BY ALL),
    v AS (SELECT id, freq, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM t),
    s AS (SELECT x.id AS q, y.id AS p, y.freq, sum(x.w * y.w) AS sim FROM v x JOIN v y ON x.term = y.term GROUP BY 1, 2, 3)
    SELECT q AS id, sum(freq)::BIGINT AS mass FROM s WHERE round(sim, 9) >= 0.8 GROUP BY q""")
def bow_neardup(spark, d):
    """For each distinct answer the number of pool rows whose answer is a near copy (bag-of-words cosine of 0.8)."""
    answers = qa_pool(spark, d).groupBy("output").agg(F.min("id").alias("id"), F.count("*").alias("freq"))
    counts = R.term_counts(answers, ["id", "freq"], X.words_plain(F.col("output")))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("id")))
    v = counts.select("id", "freq", "term", (F.col("tf") / norm).alias("w"))
    near = R.sparse_at_least(v.select("id", "term", "w"), 0.8).join(answers.select(F.col("id").alias("p"), "freq"), "p")
    return near.groupBy(F.col("q").alias("id")).agg(F.sum("freq").alias("mass"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
SELF = f"""self AS (SELECT * FROM (SELECT a.label, a.vec_id AS q, b.vec_id AS p, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 5)"""


def neighbours(spark, d, k=5):
    v = vectors(spark, d)
    return R.dense_top_k(v, v, k, "label", drop_self=True)


@query("dense_self_topk", f"WITH {SELF} SELECT q, p, sim, rank FROM self")
def dense_self(spark, d):
    return neighbours(spark, d).select("q", "p", "sim", F.col("rank").cast("long").alias("rank"))


@query("dense_topk", f"""SELECT q, p, sim FROM (SELECT a.vec_id AS q, b.vec_id AS p, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0) WHERE rank <= 3""")
def dense_topk(spark, d):
    """Evaluation vectors are every fifth, the pool all others: two disjoint sets, as the operator asks."""
    v = vectors(spark, d)
    return R.dense_top_k(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 3, "label").select("q", "p", "sim")


@query("dense_topk_fallback", f"""WITH pool AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0 AND label <> 3), s AS (SELECT a.vec_id AS q, b.vec_id AS p, {COS} AS sim FROM embeddings a JOIN pool b ON a.vec_id % 5 = 0 AND (a.label = b.label OR a.label NOT IN (SELECT label FROM pool)))
    SELECT q, p, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS rank FROM s) WHERE rank <= 3""")
def dense_topk_fallback(spark, d):
    """A label that the pool lacks is matched against the whole pool, so no question stays without an answer."""
    v = vectors(spark, d)
    return R.dense_top_k(v.where("id % 5 = 0"), v.where("id % 5 <> 0 AND label <> 3"), 3, "label", whole_pool=True).select("q", "p", "sim")


@query("margin", f"WITH {SELF} SELECT q, max(p) FILTER (rank = 1) AS p, max(sim) FILTER (rank = 1) AS sim, round(max(sim) FILTER (rank = 1) - coalesce(max(sim) FILTER (rank = 2), 0), 6) AS margin FROM self GROUP BY q")
def margin(spark, d):
    return R.margin(neighbours(spark, d)).withColumn("margin", F.round("margin", 6))


@query("mutual_best", f"WITH {SELF} SELECT x.q, x.p, x.sim FROM self x JOIN self y ON x.rank = 1 AND y.rank = 1 AND x.p = y.q AND y.p = x.q WHERE x.q < x.p")
def mutual_best(spark, d):
    n = neighbours(spark, d)
    return R.mutual_best(n, n).where("q < p")


@query("twin_match", f"""SELECT q, p, sim FROM (SELECT a.vec_id AS q, b.vec_id AS p, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON b.label = (a.label + 5) % 10) WHERE rank = 1""")
def twin_match(spark, d):
    v = vectors(spark, d)
    return R.dense_top_k(v.withColumn("label", (F.col("label") + 5) % 10), v, 1, "label").select("q", "p", "sim")


@query("skip_paired", f"""WITH {SELF}, used AS (SELECT q FROM self WHERE rank = 1 AND sim >= 0.3 UNION SELECT p FROM self WHERE rank = 1 AND sim >= 0.3)
    SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT q FROM used)""")
def skip_paired(spark, d):
    n = neighbours(spark, d).where("rank = 1 and sim >= 0.3")
    used = n.select(F.col("q").alias("vec_id")).union(n.select("p"))
    return table(spark, d, "embeddings").select("vec_id").join(used, "vec_id", "left_anti")



@query("one_to_one")
def one_to_one(spark, d):
    v = vectors(spark, d)
    return A.one_to_one_vectors(v.where("id % 2 = 0"), v.where("id % 2 = 1"), "label")


ANS = f"{SELF}, nb AS (SELECT q, p, sim, rank, 'a' || (p % 7) AS answer FROM self)"


def answered(spark, d):
    return neighbours(spark, d).select("q", "p", "sim", "rank", F.concat(F.lit("a"), F.col("p") % 7).alias("answer"))






@query("router", f"WITH {SELF} SELECT q, sim, CASE WHEN sim >= 0.4 THEN 'copy' ELSE 'generate' END AS route FROM self WHERE rank = 1")
def router(spark, d):
    return neighbours(spark, d, 1).select("q", "sim", F.when(F.col("sim") >= 0.4, "copy").otherwise("generate").alias("route"))


@query("fallback_short", f"""WITH {QA}, n AS (SELECT id, subset, output, len({words_sql('output')}) AS n FROM qa), m AS (SELECT subset, quantile_cont(n, 0.5) AS med FROM n GROUP BY subset)
    SELECT id, n::BIGINT AS n, n < 0.5 * med AS fallback FROM n JOIN m ON n.subset = m.subset""")
def fallback_short(spark, d):
    rows = qa_pool(spark, d).select("id", "subset", F.size(X.words(F.col("output"))).cast("long").alias("n"))
    med = rows.groupBy("subset").agg(F.percentile("n", 0.5).alias("med"))
    return rows.join(med, "subset").select("id", "n", (F.col("n") < 0.5 * F.col("med")).alias("fallback"))


ROUTES = f"{SELF}, rt AS (SELECT q, label AS grp, p AS target, sim, row_number() OVER (PARTITION BY label, p ORDER BY sim DESC, q) > 1 AS loser FROM self WHERE rank = 1)"


@query("twin_losers", f"WITH {ROUTES} SELECT q, target, loser FROM rt")
def twin_losers(spark, d):
    routes = neighbours(spark, d, 1).select("q", F.col("label").alias("grp"), F.col("p").alias("target"), "sim")
    return S.losers(routes).select("q", "target", "loser")






@query("shifted_choice", """WITH s AS (SELECT vec_id AS q, k AS shift, [(embedding[k + 1])::DOUBLE, (embedding[k + 2])::DOUBLE, CASE WHEN k = 1 THEN -50.0::DOUBLE ELSE embedding[k + 3]::DOUBLE END] AS lp FROM embeddings, range(3) t(k)),
    e AS (SELECT q, shift, j, exp(lp[j + 1] - list_max(lp)) / list_sum(list_transform(lp, lambda x: exp(x - list_max(lp)))) AS v FROM s, range(3) u(j))
    SELECT q, (shift + j) % 3 AS option, round(round(avg(v), 9), 6) AS p FROM e GROUP BY 1, 2""")
def shifted_choice(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), "embedding", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("shift"))
    lp = F.array(*[F.get("embedding", F.col("shift") + i).cast("double") if i < 2 else F.when(F.col("shift") != 1, F.get("embedding", F.col("shift") + 2).cast("double")) for i in range(3)])
    return S.shifted_choice(e.select("q", "shift", lp.alias("lp"))).select("q", F.col("option").cast("long").alias("option"), F.round("p", 6).alias("p"))



@query("same_answer_positives", "SELECT doc_id, n - 1 AS mates, first_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, text) AS n, min(doc_id) OVER (PARTITION BY lang, text) AS first_id FROM documents) WHERE n > 1")
def same_answer_positives(spark, d):
    """Documents that share their text with others; the mates are counted, not spelled out as pairs."""
    w = Window.partitionBy("lang", "digest")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return rows.select("doc_id", (F.count("*").over(w) - 1).alias("mates"), F.min("doc_id").over(w).alias("first_id")).where("mates > 0")


@query("relative_features", f"WITH {SELF} SELECT q, p, round((sim - avg(sim) OVER w) / (coalesce(stddev_samp(sim) OVER w, 0) + 1e-6), 4) AS sim_z, round(sim - max(sim) OVER w, 6) AS sim_gap FROM self WINDOW w AS (PARTITION BY q)")
def relative_features(spark, d):
    w = Window.partitionBy("q")
    z = (F.col("sim") - F.avg("sim").over(w)) / (F.coalesce(F.stddev_samp("sim").over(w), F.lit(0.0)) + 1e-6)
    return neighbours(spark, d).select("q", "p", F.round(z, 4).alias("sim_z"), F.round(F.col("sim") - F.max("sim").over(w), 6).alias("sim_gap"))


@query("ltr_features", f"""WITH {ANS}, fr AS (SELECT 'a' || (vec_id % 7) AS answer, label, count(*) AS freq FROM embeddings GROUP BY ALL),
    f AS (SELECT q, label, answer, 0 - ln(min(rank)) AS logrank, max((rank = 1)::INT) AS n_top1, max(sim) AS sib_sim, count(*) AS n_in_list FROM nb JOIN (SELECT vec_id, label FROM embeddings) e ON e.vec_id = nb.q GROUP BY ALL)
    SELECT q, f.answer, round(logrank, 6) AS logrank, n_top1, sib_sim, n_in_list, round(ln(greatest(1, freq - (f.answer = 'a' || (q % 7))::INT)), 6) AS lfreq FROM f JOIN fr ON fr.answer = f.answer AND fr.label = f.label""")
def ltr_features(spark, d):
    """One row per question and distinct candidate answer: ranks, top places, best sibling similarity, frequency without the row itself."""
    freq = table(spark, d, "embeddings").groupBy(F.concat(F.lit("a"), F.col("vec_id") % 7).alias("answer"), "label").agg(F.count("*").alias("freq"))
    rows = neighbours(spark, d).withColumn("answer", F.concat(F.lit("a"), F.col("p") % 7))
    f = rows.groupBy("q", "label", "answer").agg((-F.log(F.min("rank"))).alias("logrank"), F.max((F.col("rank") == 1).cast("int")).alias("n_top1"), F.max("sim").alias("sib_sim"), F.count("*").alias("n_in_list"))
    own = (F.col("answer") == F.concat(F.lit("a"), F.col("q") % 7)).cast("int")
    return f.join(freq, ["answer", "label"]).select("q", "answer", F.round("logrank", 6).alias("logrank"), "n_top1", "sib_sim", "n_in_list", F.round(F.log(F.greatest(F.lit(1), F.col("freq") - own)), 6).alias("lfreq"))


@query("candidate_features", f"""WITH {QA}, wl AS ({lexical_sql(_PLAIN, 1)}), cl AS ({lexical_sql(_CHARS, 2)}), l AS (SELECT q, p, rank, 0 AS k FROM wl UNION ALL SELECT q, p, rank, 1 FROM cl),
    f AS (SELECT l.q, o.subset, b.output AS answer, o.output AS own, coalesce(min(rank) FILTER (k = 0) - 1, 50) AS r0, coalesce(min(rank) FILTER (k = 1) - 1, 50) AS r1 FROM l JOIN qa b ON b.id = l.p JOIN qa o ON o.id = l.q GROUP BY ALL),
    fr AS (SELECT subset, output AS answer, count(*) AS freq, min(id) AS aid FROM qa GROUP BY ALL), med AS (SELECT subset, quantile_cont(len({words_sql('output')}), 0.5) AS m FROM qa GROUP BY subset),
    dt AS (SELECT subset, 'q' || id AS id, input AS t FROM qa UNION ALL SELECT subset, 'a' || id, output FROM qa), dn AS (SELECT subset, count(*) AS n FROM dt GROUP BY subset),
    dtf AS (SELECT subset, id, term, count(*) AS tf FROM (SELECT subset, id, unnest(regexp_extract_all(lower(t), '[^\\s?.,!]+')) AS term FROM dt) GROUP BY ALL),
    ddf AS (SELECT dtf.subset, term, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dtf JOIN dn ON dn.subset = dtf.subset GROUP BY ALL),
    dv AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, dtf.term, (1 + ln(tf)) * idf AS w FROM dtf JOIN ddf ON ddf.subset = dtf.subset AND ddf.term = dtf.term)),
    qs AS (SELECT f.q, fr.aid, sum(x.w * y.w) AS s FROM f JOIN fr ON fr.subset = f.subset AND fr.answer = f.answer JOIN dv x ON x.id = 'q' || f.q JOIN dv y ON y.id = 'a' || fr.aid AND y.term = x.term GROUP BY ALL),
    ctf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_CHARS}) AS term FROM qa) GROUP BY ALL), cdf AS (SELECT term, ln((1 + (SELECT count(*) FROM qa)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM ctf GROUP BY term HAVING count(*) >= 2),
    cv AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, ctf.term, (1 + ln(tf)) * idf AS w FROM ctf JOIN cdf ON cdf.term = ctf.term)),
    sp AS (SELECT f.q, f.answer, b.id AS p FROM f JOIN qa b ON b.subset = f.subset AND b.output = f.answer), sd AS (SELECT sp.q, sp.p, sum(x.w * y.w) AS s FROM (SELECT DISTINCT q, p FROM sp WHERE q <> p) sp JOIN cv x ON x.id = sp.q JOIN cv y ON y.id = sp.p AND y.term = x.term GROUP BY ALL),
    sb AS (SELECT sp.q, sp.answer, max(CASE WHEN sp.q = sp.p THEN -1 ELSE coalesce(sd.s, 0) END) AS s FROM sp LEFT JOIN sd ON sd.q = sp.q AND sd.p = sp.p GROUP BY ALL)
    SELECT f.q, f.answer, round(-ln(1 + r0), 6) + 0 AS logrank_0, round(-ln(1 + r1), 6) + 0 AS logrank_1, (r0 = 0)::INT + (r1 = 0)::INT AS n_top1, round(coalesce(qs.s, 0), 6) AS q_ans, round(sb.s, 6) AS sib_char,
      round(ln(greatest(1, freq - (f.answer = own)::INT)), 6) AS lfreq, round(len({words_sql('f.answer')}) / m, 6) AS len_ratio
    FROM f JOIN fr ON fr.subset = f.subset AND fr.answer = f.answer JOIN med ON med.subset = f.subset LEFT JOIN qs ON qs.q = f.q AND qs.aid = fr.aid JOIN sb ON sb.q = f.q AND sb.answer = f.answer""")
def candidate_features(spark, d, texts=True):
    """Candidates of a word and a character ranker over the real pool, with their features."""
    from askloom.operators import ranking as K

    chars = question_files(spark, d, X.char_ngrams, 2)  # the list and the siblings read the same files
    lists = [lexical(spark, d, lambda c: X.words_plain(F.lower(c))), listed(chars)]
    return K.candidate_features(lists, qa_pool(spark, d), X.words_plain(F.lower(F.col("t"))), chars, texts)


LTR_FEATURES = ["logrank_0", "logrank_1", "n_top1", "q_ans", "sib_char", "lfreq", "len_ratio"]


@query("ltr_predict")
def ltr_predict(spark, d):
    """LambdaRank over the candidates' features, out of fold by question: the best answer of each question, its agreement
    with the question's own answer, and the question's NDCG. Boosting is iterative, so there is no SQL."""
    from askloom.operators import boosting as G
    from askloom.operators import ranking as K
    from askloom.operators.filed import attached, filed
    from askloom.storage import Rounds

    texts = filed(qa_pool(spark, d).select("id", "subset", F.col("output").alias("answer")), "subset")
    rows = K.graded_files(candidate_features(spark, d, False), texts, "answer").withColumn("fold", K.question_fold(F.col("q"), 2))
    rows = Rounds(spark).put("candidates", rows)
    models = G.boost(rows, LTR_FEATURES, "q", "place", "label", "fold", 2, trees=6, rate=0.2, least=10)
    scored = G.predict(rows, models, "fold")
    best = R.top_k(scored, 1, ["q"], [F.desc("score"), F.asc("place")]).join(G.ndcg(scored, "q", "place"), "q")
    return attached(best, "subset", ("aid", texts, {"answer": "answer"})).select("q", "answer", "score", "overlap", "ndcg")
