"""Queries of splits, statistics, validation, ledgers and queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import ledger as L
from askloom.operators import order_stats as O
from askloom.operators import splits as P
from askloom.operators import validation as V
from askloom.plans.common import QA, qa_pool, table, words_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ranked_sql(seed: int, by: str = "lang") -> str:
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM documents)"


@query("holdout_split", f"WITH {ranked_sql(1234)} SELECT doc_id, rn <= greatest(1, round_even(n * 0.07, 0)) AS held FROM r")
def holdout_split(spark, d):
    return P.hold_out(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.07).select("doc_id", "held")


@query("three_way_split", f"WITH {ranked_sql(42)} SELECT doc_id, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' WHEN rn <= round_even(n * (0.8 + 0.1), 0) THEN 'val' ELSE 'test' END AS split FROM r")
def three_way_split(spark, d):
    return P.three_way(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", (0.8, 0.1, 0.1)).select("doc_id", "split")


@query("kfold", f"WITH {ranked_sql(7)} SELECT doc_id, ((rn - 1) % 5)::INT AS fold FROM r")
def kfold(spark, d):
    return P.folds(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5).select("doc_id", "fold")


@query("sample_per_group", f"WITH {ranked_sql(0)} SELECT doc_id, lang FROM r WHERE rn <= 25")
def sample_per_group(spark, d):
    return P.sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 25)


@query("overlap_audit", "SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def overlap_audit(spark, d):
    """Texts on both sides of a split by parity, as digests: the texts themselves need not move."""
    t = table(spark, d, "documents").select(F.sha2("text", 256).alias("x"), (F.col("doc_id") % 2).alias("side"))
    return t.where("side = 0").select("x").intersect(t.where("side = 1").select("x")).agg(F.count("*").alias("shared"))


@query("disjoint_check", "SELECT doc_id, 2::BIGINT AS splits FROM documents WHERE doc_id % 3 = 2 AND doc_id % 4 < 2")
def disjoint_check(spark, d):
    """Keys that stand in two of three splits that were not made disjoint."""
    docs = table(spark, d, "documents").select("doc_id")
    part = lambda c, n: docs.where(c).withColumn("split", F.lit(n))
    return P.disjoint(part("doc_id % 3 = 2", "a").unionByName(part("doc_id % 4 < 2", "b")).unionByName(part("doc_id % 3 = 2", "a")), "doc_id")


@query("length_stats", f"""WITH w AS (SELECT lang, len({words_sql('text')}) AS n FROM documents)
    SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90 FROM w GROUP BY GROUPING SETS ((lang), ())""")
def length_stats(spark, d):
    w = table(spark, d, "documents").select("lang", F.size(X.words(F.col("text"))).alias("n"))
    pct = lambda q, n: F.round(F.percentile("n", q), 6).alias(n)
    return w.rollup("lang").agg(F.count("*").alias("n_"), F.round(F.avg("n"), 6).alias("mean"), pct(0.1, "p10"), pct(0.5, "median"), pct(0.9, "p90")).withColumnRenamed("n_", "n").withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@query("length_bounds", f"""WITH {QA}, w AS (SELECT subset, len({words_sql('output')}) AS n FROM qa)
    SELECT subset, greatest(1, trunc(round(quantile_cont(n, 0.05), 6)))::BIGINT AS min_new, (trunc(round(quantile_cont(n, 0.95), 6)) + 8)::BIGINT AS max_new FROM w GROUP BY subset""")
def length_bounds(spark, d):
    w = qa_pool(spark, d).select("subset", F.size(X.words(F.col("output"))).alias("n"))
    cut = lambda q: F.round(F.percentile("n", q), 6).cast("long")
    return w.groupBy("subset").agg(F.greatest(F.lit(1), cut(0.05)).cast("long").alias("min_new"), (cut(0.95) + 8).alias("max_new"))


@query("length_policy", f"""WITH {QA}, w AS (SELECT subset, len({words_sql('output')}) AS n FROM qa), l AS (SELECT subset, list_sort(list(n)) AS a FROM w GROUP BY subset)
    SELECT subset, a[(trunc(len(a) * 0.1) + 1)::INT]::BIGINT AS lo, a[(trunc(len(a) * 0.9) + 1)::INT]::BIGINT AS hi FROM l""")
def length_policy(spark, d):
    """Not interpolated: the value at position int(n*q) of the lengths in order, by refined histograms."""
    rows = qa_pool(spark, d).select("subset", F.size(X.words(F.col("output"))).cast("long").alias("n"))
    out = O.order_statistics(rows, "subset", "n", {"lo": lambda n: (n * 0.1).cast("int"), "hi": lambda n: (n * 0.9).cast("int")})
    return out.select("subset", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query("text_percentiles", "SELECT lang, count(*) AS n, round(quantile_cont(length(text), 0.01), 6) AS p01, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.99), 6) AS p99 FROM documents GROUP BY lang")
def text_percentiles(spark, d):
    """Interpolated percentiles of the texts' lengths, exact at any size."""
    rows = table(spark, d, "documents").select("lang", F.length("text").alias("size"))
    out = O.percentiles(rows, "lang", "size", {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("p01", "p50", "p99")])


@query("share_by_lang", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang")
def share_by_lang(spark, d):
    return L.shares(table(spark, d, "documents"), "lang").withColumn("share", F.round("share", 6))


@query("class_pivot", f"WITH {ranked_sql(42)}, s AS (SELECT lang, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' WHEN rn <= round_even(n * (0.8 + 0.1), 0) THEN 'val' ELSE 'test' END AS split FROM r) SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s GROUP BY lang")
def class_pivot(spark, d):
    s = P.three_way(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", (0.8, 0.1, 0.1))
    return s.groupBy("lang").pivot("split", ["train", "val", "test"]).count().fillna(0)


@query("class_tolerance", f"""WITH {ranked_sql(42)}, s AS (SELECT lang, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' WHEN rn <= round_even(n * (0.8 + 0.1), 0) THEN 'val' ELSE 'test' END AS split FROM r),
    c AS (SELECT lang, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s GROUP BY lang),
    p AS (SELECT lang, round(train / n, 4) AS train_share, round(val / n, 4) AS val_share, round(test / n, 4) AS test_share FROM c)
    SELECT *, round(abs(train_share - 0.8), 6) <= 0.002 AND round(abs(val_share - 0.1), 6) <= 0.002 AND round(abs(test_share - 0.1), 6) <= 0.002 AS ok FROM p""")
def class_tolerance(spark, d):
    """Whether each language's shares of a split are near their targets."""
    return V.within_tolerance(class_pivot(spark, d), "lang", {"train": 0.8, "val": 0.1, "test": 0.1}, 0.002)


@query("null_report", "SELECT * FROM (SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS nulls FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def null_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return V.null_report(docs)


@query("drift_flags", """WITH a AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 3 = 0 GROUP BY lang), b AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 3 <> 0 GROUP BY lang)
    SELECT coalesce(a.lang, b.lang) AS lang, round(coalesce(a.s, 0)::DOUBLE, 6) AS left_share, round(coalesce(b.s, 0)::DOUBLE, 6) AS right_share, round(coalesce(a.s, 0)::DOUBLE, 6) < 0.1 AS small, abs(round(coalesce(a.s, 0)::DOUBLE, 6) - round(coalesce(b.s, 0)::DOUBLE, 6)) > 0.15 AS diverges FROM a FULL JOIN b ON a.lang = b.lang""")
def drift_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return V.drift(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), "lang")


@query("submission_build", f"WITH {QA} SELECT id AS ID, coalesce(output, '') AS TargetRLF1, coalesce(output, '') AS TargetR1F1, coalesce(output, '') AS TargetLLM FROM qa")
def submission_build(spark, d):
    return V.build_submission(qa_pool(spark, d), "id", "output")


@query("submission_validate", f"""WITH {QA}, s AS (SELECT id, coalesce(output, '') AS a FROM qa WHERE conv_id % 10 <> 3), m AS (SELECT count(*) AS k FROM qa WHERE id NOT IN (SELECT id FROM s))
    SELECT count(*) AS n_rows, count(id) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (id = '') AS empty_ids, 0::BIGINT AS unequal_targets, count(*) FILTER (a = '') AS empty_answers, round(avg(length(a)), 6) AS mean_chars, (SELECT k FROM m) AS missing_ids, 0::BIGINT AS extra_ids FROM s""")
def submission_validate(spark, d):
    pool = qa_pool(spark, d)
    return V.validate_submission(V.build_submission(pool.where("conv_id % 10 <> 3"), "id", "output"), pool.select(F.col("id").alias("ID")))


@query("id_diff", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_diff(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(labels.join(docs, "doc_id", "left_anti").withColumn("side", F.lit("extra")))


RUNS = "runs AS (SELECT event_type AS subset, event_id AS seq, 'r' || event_id AS run, round(value / 100, 4) AS val, round(((value * 7) % 50) / 100, 4) AS held FROM events)"


def runs(spark, d):
    """The run log: every event is a run of its type."""
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("subset"), F.col("event_id").alias("seq"), F.concat(F.lit("r"), F.col("event_id")).alias("run"), F.round(F.col("value") / 100, 4).alias("val"), F.round(((F.col("value") * 7) % 50) / 100, 4).alias("held"))


STEPS = f"""WITH RECURSIVE {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY seq) AS k FROM runs),
    f(subset, k, seq, run, val, held, won, bv, bh) AS (
      SELECT subset, k, seq, run, val, held, true, val, held FROM o WHERE k = 1
      UNION ALL SELECT o.subset, o.k, o.seq, o.run, o.val, o.held, o.val - bv >= 0.003 AND o.held - bh >= -0.003,
        CASE WHEN o.val - bv >= 0.003 AND o.held - bh >= -0.003 THEN o.val ELSE bv END, CASE WHEN o.val - bv >= 0.003 AND o.held - bh >= -0.003 THEN o.held ELSE bh END FROM f JOIN o ON o.subset = f.subset AND o.k = f.k + 1)"""


@query("champion_replay", f"{STEPS} SELECT subset, seq, run, won FROM f")
def champion_replay(spark, d):
    return L.champion_steps(runs(spark, d)).select("subset", "seq", "run", "won")


@query("champions", f"{STEPS} SELECT subset, max_by(run, seq) AS run, max_by(val, seq) AS val, max_by(held, seq) AS held FROM f WHERE won GROUP BY subset")
def champions(spark, d):
    return L.champions(L.champion_steps(runs(spark, d)))


@query("mix_weighted", f"{STEPS}, c AS (SELECT subset, max_by(val, seq) AS val FROM f WHERE won GROUP BY subset), m AS (SELECT event_type AS subset, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT round(sum(n * round(val, 4)) / sum(n), 4) AS score, count(*) AS covered FROM c JOIN m ON c.subset = m.subset")
def mix_weighted(spark, d):
    mix = L.shares(table(spark, d, "events").select(F.col("event_type").alias("subset")), "subset")
    return L.weighted_mean(L.champions(L.champion_steps(runs(spark, d))), mix, "subset", "val")


@query("queue_pending", """WITH done AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id), claimed AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id), now AS (SELECT max(ts) AS now FROM events)
    SELECT e.event_id FROM events e LEFT JOIN done d ON d.user_id = e.user_id LEFT JOIN claimed c ON c.user_id = e.user_id, now
    WHERE e.event_type = 'signup' AND coalesce(d.last, -1) < e.event_id AND (c.ts IS NULL OR epoch_us(now) - epoch_us(c.ts) >= 900000000)""")
def queue_pending(spark, d):
    """Queued specs (signups) without a later result (purchase) and without a claim (click) of the last 900 seconds."""
    e = table(spark, d, "events")
    of = lambda k: e.where(F.col("event_type") == k)
    now = e.agg(F.max("ts").alias("now"))
    done = of("purchase").groupBy("user_id").agg(F.max("event_id").alias("last"))
    fresh = of("click").groupBy("user_id").agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(now)).where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) < 900_000_000)  # now is one row
    return of("signup").join(done, "user_id", "left").where("last IS NULL OR last < event_id").join(fresh, "user_id", "left_anti").select("event_id")


@query("group_complete", "SELECT user_id, count(DISTINCT event_type) AS parts, max(event_id) AS last_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def group_complete(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("parts"), F.max("event_id").alias("last_id")).where("parts = 5")


@query("lease_expired", "SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 3600000000")
def lease_expired(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max("ts").alias("ts")).crossJoin(F.broadcast(now))
    return last.where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 3_600_000_000).select("user_id", "last_id")


@query("length_batches", "SELECT doc_id, ((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def length_batches(spark, d):
    """Batches of 32 texts of like length inside a language."""
    rows = P.ordinal(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", F.col("n_chars"), [F.col("doc_id")])
    return rows.select("doc_id", F.floor((F.col("rn") - 1) / 32).cast("long").alias("batch"))


@query("file_manifest")
def file_manifest(spark, d):
    """SHA-256 and size of each file of a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{d}/labels.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


_ROW = "concat_ws(',', length(doc_id::VARCHAR) || ':' || doc_id, CASE WHEN text IS NULL THEN '-' ELSE length(text) || ':' || text END)"
_NODE = "sha256(string_agg(pos || ':' || h || ':' || n, ';' ORDER BY pos, h, n))"


@query("table_fingerprint", f"""WITH r AS (SELECT doc_id AS pos, sha256({_ROW}) AS h, count(*) AS n FROM documents GROUP BY ALL), a AS (SELECT pos // 64 AS pos, {_NODE} AS h, 1 AS n FROM r GROUP BY pos // 64),
    b AS (SELECT pos // 64 AS pos, {_NODE} AS h, 1 AS n FROM a GROUP BY pos // 64), c AS (SELECT {_NODE} AS h FROM b)
    SELECT 1 AS level, pos AS node, h AS digest FROM a UNION ALL SELECT 2, pos, h FROM b UNION ALL SELECT 0, 0, h FROM c""")
def table_fingerprint(spark, d):
    """A digest tree of the texts in the order of their ids."""
    return V.digest_tree(table(spark, d, "documents"), "doc_id", ["doc_id", "text"], 64, 2)


@query("drifted_ranges", "SELECT DISTINCT 1 AS level, doc_id // 64 AS node FROM labels WHERE toxic = 1 UNION SELECT 2, doc_id // 4096 FROM labels WHERE toxic = 1 UNION SELECT 0, 0 FROM labels WHERE toxic = 1")
def drifted_ranges(spark, d):
    """Where a table and its copy with one label turned round differ: only the ranges on the way to changed rows."""
    rows = table(spark, d, "labels")
    tree = lambda x: V.digest_tree(x, "doc_id", ["doc_id", "quality", "toxic"], 64, 2)
    return V.differing_ranges(tree(rows), tree(rows.withColumn("toxic", F.lit(0))))


@query("json_props", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@query("ranked_lists", "SELECT user_id, string_agg(event_id::VARCHAR, '|' ORDER BY value DESC, event_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id")
def ranked_lists(spark, d):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    top = table(spark, d, "events").withColumn("rn", rn).where("rn <= 5")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string"))
    return top.groupBy("user_id").agg(F.array_join(ids, "|").alias("ids"))


_LINKS = "l AS (SELECT DISTINCT '/' || split_part(split_part(url, '://', 2), '/', 2) AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages), n AS (SELECT DISTINCT '/' || split_part(split_part(url, '://', 2), '/', 2) AS name FROM pages)"


@query("link_lint", f"WITH {_LINKS} SELECT 'dead' AS kind, source AS name, target FROM l WHERE target NOT IN (SELECT name FROM n) UNION ALL SELECT 'orphan', name, NULL FROM n WHERE name NOT IN (SELECT target FROM l WHERE source <> target)")
def link_lint(spark, d):
    """Links of pages to sections (the first part of an address) that no page has, and sections that no other links to."""
    from askloom.operators import reports as T

    section = F.concat(F.lit("/"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)))
    pages = table(spark, d, "pages").select(section.alias("name"), "html")
    links = pages.select(F.col("name").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    dead, orphans = T.link_lint(links, pages)
    return dead.select(F.lit("dead").alias("kind"), F.col("source").alias("name"), "target").unionByName(orphans.select(F.lit("orphan").alias("kind"), "name", F.lit(None).cast("string").alias("target")))
