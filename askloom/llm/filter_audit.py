"""Filter interaction audit (op 11) by packed bitmaps: what each filter removes in every order of five filters.

Each batch of rows is sorted by part and each part is padded to whole bytes, so a part's bitset is a run of bytes. The
failures of the filters and the two labels are bitsets over the same rows. For each of the 32 sets of filters that can
stand before a step, the rows that pass them are found by AND-NOT and counted by popcount, per part and label; the
counts of all batches are added up by Spark. All columns of the report follow from these 32 x 3 numbers of a part, so
the 120 orders cost no further pass.

Filter E needs the whole table: of equal texts (by SHA-256) the row with the smallest id passes. The passing ids are
joined back by id and hash, never by hash alone, so a large group of copies is dealt over all tasks.

A null text is empty, a null part is the empty string. A null id is smaller than any other. Rows that repeat an id and
a text are no copies of each other, as neither id is smaller. Several labels of one id count as one row: 1 where any is
1; null labels are 0. Empty tables have no parts and no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import UPPER, held, table, words, written

FILTERS = "ABCDE"
NO_ID = -(1 << 63)
SETS = 1 << len(FILTERS)
MARKS = "#$%&*|"


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, A to E, good, toxic: one row per row of docs."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"))
    own = own.withColumn("w", held(words(F.col("t"))))
    size = F.size("w")
    own = own.select(
        "id",
        "part",
        F.unhex(F.sha2("t", 256)).alias("h"),
        (size < 200).alias("A"),
        (100 * F.size(F.array_distinct("w")) < 50 * size).alias("B"),
        (100 * (F.length("t") - F.length(F.translate("t", UPPER, ""))) > 3 * F.length("t")).alias("C"),
        (F.length("t") > F.length(F.translate("t", MARKS, ""))).alias("D"),
    )
    own = written(own, "audit")
    first = own.groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col(key).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = own.join(first, ["id", "h"], "left").join(known, "id", "left")
    return both.select("part", "A", "B", "C", "D", F.col("first").isNull().alias("E"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def counts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """part, passed (set of filters as bits), kept, good, toxic of the batch's rows."""
    coded = rows.column(0).dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(names))
    starts = np.concatenate(([0], np.cumsum((sizes + 7) // 8)))  # in bytes
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = (8 * starts[:-1] - before)[codes[order]] + np.arange(len(codes))

    def bitset(values: np.ndarray) -> np.ndarray:
        bits = np.zeros(8 * starts[-1], np.uint8)
        bits[at] = values
        return np.packbits(bits)

    flag = lambda k: bitset(rows.column(k).to_numpy(zero_copy_only=False).astype(np.uint8)[order])
    member = bitset(np.ones(len(codes), np.uint8))
    fails = [flag(k) for k in range(1, 1 + len(FILTERS))]
    shown = [member, flag(len(FILTERS) + 1), flag(len(FILTERS) + 2)]
    out = np.empty((3, SETS, len(names)), np.int64)
    gone = [np.zeros_like(member)]
    for s in range(1, SETS):
        low = s & -s
        gone.append(gone[s ^ low] | fails[low.bit_length() - 1])
    for s in range(SETS):
        kept = member & ~gone[s]
        for k, bits in enumerate(shown):
            out[k, s] = np.add.reduceat(np.bitwise_count(kept & bits), starts[:-1], dtype=np.int64)
    part = names.take(pa.array(np.tile(np.arange(len(names)), SETS)))
    return pa.RecordBatch.from_arrays([part, pa.array(np.repeat(np.arange(SETS, dtype=np.int32), len(names))), *[pa.array(x.ravel()) for x in out]], ["part", "passed", "kept", "good", "toxic"])


def prefix_counts(rows: DataFrame) -> DataFrame:
    """part, passed, kept, good, toxic over all rows: the rows of a part that no filter of the set rejects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield counts(batch)

    out = rows.mapInArrow(run, "part string, passed int, kept long, good long, toxic long")
    return out.groupBy("part", "passed").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def report(sums: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the 32 sums of a part."""
    own = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("passed", "kept", "good", "toxic"))).alias("s"))  # 32 entries a part
    at = lambda passed, what="kept": F.get("s", passed)[what]

    def over_orders(bit: int) -> Column:
        """What the filter removes, summed over all orders: each set stands before it in |S|! (4 - |S|)! of them."""
        return sum(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) * (at(F.lit(s)) - at(F.lit(s | bit))) for s in range(SETS) if not s & bit)

    own = own.withColumn("all_orders", F.array(*[over_orders(1 << k) for k in range(len(FILTERS))]))
    own = own.select("*", F.explode(F.array(*[F.lit("".join(x)) for x in permutations(FILTERS)])).alias("filter_order"))
    own = own.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    k = F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    before = sum(F.when(F.instr("filter_order", name) < F.col("step"), 1 << j).otherwise(0) for j, name in enumerate(FILTERS))
    own = own.withColumns({"k": k, "bit": F.call_function("shiftleft", F.lit(1), k), "b": before})
    after = F.col("b") + F.col("bit")
    removed = at(F.col("b")) - at(after)
    return own.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        at(after).alias("kept"),
        removed.alias("removed"),
        (at(F.lit(0)) - at(F.col("bit")) - removed).alias("redundant"),
        (at(F.lit(SETS - 1) - F.col("bit")) - at(F.lit(SETS - 1))).alias("unique_fails"),
        (at(F.col("b"), "good") - at(after, "good")).alias("good_lost"),
        (at(F.col("b"), "toxic") - at(after, "toxic")).alias("toxic_lost"),
        F.get("all_orders", F.col("k")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(prefix_counts(flagged(docs, labels)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
    known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (
      SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 3 * length(t.text) AS c,
        regexp_matches(t.text, '[#$%&*|]') AS d, t.doc_id > firsts.first AS e, coalesce(good, false) AS good, coalesce(known.toxic, false) AS toxic
      FROM t JOIN firsts ON t.text = firsts.text LEFT JOIN known ON t.doc_id = known.doc_id),
    own AS (SELECT part, list_value(a, b, c, d, e) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM l v, l w, l x, l y, l z WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
    steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
    s AS (SELECT *, instr('ABCDE', filter_order[step]) AS k, list_transform(string_split(filter_order[1:step - 1], ''), lambda c: instr('ABCDE', c)) AS earlier FROM steps),
    j AS (
      SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS failing, step > 1 AND list_bool_or([fails[i] FOR i IN earlier IF i > 0]) IS TRUE AS gone,
        len(list_filter(fails, lambda z: z)) AS n_fails FROM own, s),
    r AS (
      SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
      FROM j GROUP BY part, filter_order, step, k)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""
