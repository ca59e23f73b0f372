"""Quality rules (op 4) with adaptive thresholds, in DataFrame functions only.

Each document gets five counts and four measures per thousand. For every language and source a quantile sketch of each
measure is kept: a histogram over buckets that hold the six leading binary digits of a value, so a bucket is at most
1/32 wide and two sketches merge by adding counts. The sketches of a language's sources merge to the language's, and
those to the whole corpus's; a group with fewer than `least` documents uses the next wider one. A document is kept if
every measure lies within limits that are read off the sketch in two steps:
1. A fence around the quartiles, [q1 - reach * spread, q3 + reach * spread], where spread is q3 - q1 and no less than a least
   spread, cuts gross outliers off the sketch, so that much junk in a group can't widen its own limits.
2. Of what is left, the limits lie beyond the first and the 99th percentile by TAIL halves of their distance to the median.
Only where a tail has no length (the percentile is the median) the fence itself is the limit. Documents that fail the base
rules are in no sketch: they would move the thresholds of the others.

Words and windows are told apart by 64 bits of a hash: in a text of a million words two different windows count as one with
odds of about 1 to 37 million.

A null text has no words and fails the base rules. Null languages and sources are groups like any other. Repeated
rows count as often as they occur. Columns with other names than the three read are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import SPACE, cut, held, table, words, written

WINDOW = 8
LEAST_WORDS = 20
MEASURES = ("word_len", "symbols", "dup_lines", "repeats")
LEAST = 200
REACH, TAIL = 4, 3
SPREAD = {"word_len": 400, "symbols": 50, "dup_lines": 90, "repeats": 60}
BROADCAST_ROWS, REJECTED_ROWS = 20_000, 500_000


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    own = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    own = own.withColumn("_w", held(F.transform(words(F.col("_t")), lambda w: F.xxhash64(w))))
    own = own.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != ""))
    own = own.withColumn("n_words", F.size("_w").cast("long"))
    last = F.col("n_words") - WINDOW
    grams = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    own = own.withColumn("_g", held(F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>"))))
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    own = own.withColumn("_s", held(F.when(repeated, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))))
    twins = F.filter("_s", lambda x, j: ((j > 0) & F.coalesce(F.get("_s", j - 1)["g"] == x["g"], F.lit(False))) | F.coalesce(F.get("_s", j + 1)["g"] == x["g"], F.lit(False)))
    own = own.withColumn("_p", held(F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twins, lambda x: x["i"].cast("long"))))))
    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", nothing, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return own.select(
        *[c for c in docs.columns],
        "n_words",
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        held(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def measures(counted: DataFrame) -> DataFrame:
    """counted with the four measures as whole numbers per thousand; null where the base rules failed."""
    per = lambda a, b: F.when(~F.col("base_failed") & (F.col(b) > 0), F.expr(f"1000 * {a} div {b}"))
    return counted.withColumns({"word_len": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")})


def bucket(value: Column) -> Column:
    """The lower edge of a value's bucket: its six leading binary digits."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """One row per group, measure and bucket with its count: the mergeable sketch."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x")
    out = measured.where(~F.col("base_failed")).select(*by, rows).select(*by, "x.measure", "x.bucket")
    return out.groupBy(*by, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups merged to those of coarser ones."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, by: list[str]) -> DataFrame:
    """size, lo, hi, lo_read and hi_read (whether the data's tail or the fence set them) by group and measure; a sketch has
    under 2,000 buckets, so a group is a small array."""
    held = sketches.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("size"))

    def at(b: str, size: str, part: int, of: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("v"))
        step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["v"].isNull() & (of * (a["n"] + x["n"]) >= part * F.col(size)), x["bucket"]).otherwise(a["v"]).alias("v"))
        return F.aggregate(b, start, step, lambda a: a["v"])

    floor = F.create_map(*[F.lit(x) for m in MEASURES for x in (m, SPREAD[m])])
    held = held.withColumns({"q1": at("b", "size", 1, 4), "q3": at("b", "size", 3, 4)})
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), F.element_at(floor, F.col("measure")))
    held = held.withColumns({"lo0": F.col("q1") - spread, "hi0": F.col("q3") + spread})
    held = held.withColumn("c", F.filter("b", lambda x: x["bucket"].between(F.col("lo0"), F.col("hi0"))))
    held = held.withColumn("left", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    held = held.withColumns({"p1": at("c", "left", 1, 100), "p50": at("c", "left", 1, 2), "p99": at("c", "left", 99, 100)})
    low, high = F.col("p1") < F.col("p50"), F.col("p99") > F.col("p50")
    return held.select(
        *by,
        "measure",
        "size",
        F.when(low, F.expr(f"p1 - {TAIL} * (p50 - p1) div 2")).otherwise(F.col("lo0")).alias("lo"),
        F.when(high, F.expr(f"p99 + {TAIL} * (p99 - p50) div 2")).otherwise(F.col("hi0")).alias("hi"),
        low.alias("lo_read"),
        high.alias("hi_read"),
    )


def thresholds(measured: DataFrame, least: int = LEAST) -> DataFrame:
    """A row per language and source with lo_ and hi_ of every measure."""
    fine = cut(sketch(measured, ["lang_", "source_"]))
    wide, whole = merge(fine, ["lang_"]), merge(fine, [])
    own = limits(fine, ["lang_", "source_"])
    up = limits(wide, ["lang_"]).select("lang_", "measure", *[F.col(c).alias(f"w_{c}") for c in ("size", "lo", "hi")])
    top = limits(whole, []).select("measure", *[F.col(c).alias(f"a_{c}") for c in ("lo", "hi")])
    own = own.join(up, ["lang_", "measure"]).join(F.broadcast(top), ["measure"])  # top has a row per measure
    pick = lambda q: F.when(F.col("size") >= least, F.col(q)).when(F.col("w_size") >= least, F.col(f"w_{q}")).otherwise(F.col(f"a_{q}"))
    own = own.select("lang_", "source_", "measure", pick("lo").alias("lo"), pick("hi").alias("hi"))
    pivot = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{e}_{m}") for m in MEASURES for e in ("lo", "hi")]
    return own.groupBy("lang_", "source_").agg(*pivot)


def keyed(docs: DataFrame, lang: str, source: str) -> DataFrame:
    return docs.withColumns({"lang_": F.coalesce(F.col(lang).cast("string"), F.lit("")), "source_": F.coalesce(F.col(source).cast("string"), F.lit(""))})


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with kept. limits are broadcast only where they are few; else Spark joins by a shuffle it can split."""
    limits = cut(limits)
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(True))
    return measured.join(limits, ["lang_", "source_"], "left").withColumn("kept", ~F.col("base_failed") & inside)


def filter_documents(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns they had."""
    own = docs.select(F.struct("*").alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).cast("string").alias("t"))
    keys = lambda x: [F.xxhash64(F.lit(k), "lang_", "source_", F.coalesce(x, F.lit(""))).alias(f"k{k}") for k in (1, 2)]
    keyed_rows = keyed(own, "lang", "source")
    # words are counted once, for thresholds and verdicts; rows find their verdict by two hashes of what it depends on
    narrow = measures(count_words(keyed_rows.select("lang_", "source_", "t", *keys(F.col("t"))), "t")).select("k1", "k2", "lang_", "source_", "base_failed", *MEASURES)
    narrow = written(narrow, "measured")
    rejected = cut(judged(narrow, thresholds(narrow)).where("not kept").select("k1", "k2").distinct())
    if rejected.limit(REJECTED_ROWS + 1).count() <= REJECTED_ROWS:  # two numbers a row
        rejected = F.broadcast(rejected)
    return keyed_rows.select("row", *keys(F.col("t"))).join(rejected, ["k1", "k2"], "left_anti").select("row.*")


def score_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts and verdict of every row of docs; the counts are written once and read for sketches and verdicts."""
    own = keyed(docs.select(F.col(key).alias("doc_id"), "lang", "source", "text"), "lang", "source")
    counted = count_words(own.drop("lang", "source")).drop("text")
    measured = measures(written(counted, "quality"))
    return judged(measured, thresholds(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for the query."""
    bit = lambda m: f"(({m} >> greatest(length(bin({m})) - 6, 0)) << greatest(length(bin({m})) - 6, 0))"
    sketches = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {bit(m)} AS bucket, count(*) AS n FROM measured WHERE NOT base_failed GROUP BY ALL" for m in MEASURES)
    quart = lambda by, src: f"""SELECT {by}measure, size, min(bucket) FILTER (4 * run >= size) AS q1, min(bucket) FILTER (4 * run >= 3 * size) AS q3
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {by}measure) AS size FROM {src}) GROUP BY ALL"""  # noqa: E731
    floor = "CASE measure " + " ".join(f"WHEN '{m}' THEN {SPREAD[m]}" for m in MEASURES) + " END"
    tails = lambda by, src, q: f"""SELECT {by}measure, size, CASE WHEN p1 < p50 THEN p1 - {TAIL} * (p50 - p1) // 2 ELSE lo0 END AS lo, CASE WHEN p99 > p50 THEN p99 + {TAIL} * (p99 - p50) // 2 ELSE hi0 END AS hi FROM (
        SELECT {by}measure, size, lo0, hi0, min(bucket) FILTER (100 * run >= rest) AS p1, min(bucket) FILTER (2 * run >= rest) AS p50, min(bucket) FILTER (100 * run >= 99 * rest) AS p99
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {by}measure) AS rest
          FROM {src} JOIN (SELECT *, q1 - {REACH} * greatest(q3 - q1, {floor}) AS lo0, q3 + {REACH} * greatest(q3 - q1, {floor}) AS hi0 FROM ({q})) USING ({by}measure) WHERE bucket BETWEEN lo0 AND hi0) GROUP BY ALL)"""  # noqa: E731
    limit = lambda by, src: tails(by, src, quart(by, src))
    inside = " AND ".join(f"NOT coalesce(bool_or(t.measure = '{m}' AND m.{m} NOT BETWEEN t.lo AND t.hi), false)" for m in MEASURES)
    return rf"""
    WITH w AS (
      SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM documents),
    g AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
        SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram FROM w WHERE len(w) >= {WINDOW})),
    r AS (
      SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (
        SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY doc_id),
    counted AS (
      SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    measured AS (
      SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words) AS base_failed, 1000 * word_chars // nullif(n_words, 0) AS word_len,
        1000 * n_symbols // nullif(n_words, 0) AS symbols, 1000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines, 1000 * n_repeat_words // nullif(n_words, 0) AS repeats FROM counted),
    fine AS ({sketches}),
    wide AS (SELECT lang, measure, bucket, sum(n)::BIGINT AS n FROM fine GROUP BY ALL),
    whole AS (SELECT measure, bucket, sum(n)::BIGINT AS n FROM fine GROUP BY ALL),
    f AS ({limit('lang, source, ', 'fine')}), u AS ({limit('lang, ', 'wide')}), a AS ({limit('', 'whole')}),
    t AS (
      SELECT f.lang, f.source, f.measure, CASE WHEN f.size >= {LEAST} THEN f.lo WHEN u.size >= {LEAST} THEN u.lo ELSE a.lo END AS lo,
        CASE WHEN f.size >= {LEAST} THEN f.hi WHEN u.size >= {LEAST} THEN u.hi ELSE a.hi END AS hi
      FROM f JOIN u ON f.lang = u.lang AND f.measure = u.measure JOIN a ON f.measure = a.measure)
    SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, (NOT m.base_failed AND {inside}) AS kept
    FROM measured m LEFT JOIN t ON m.lang = t.lang AND m.source = t.source
    GROUP BY m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed"""
