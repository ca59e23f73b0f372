"""N-gram Jaccard join (op 8): a prefix-tree join of the documents' sets of 5-word shingles.

1. Documents with equal sets become one; its number is the smallest id.
2. Sets are put in one order, by hash. With overlap `o >= t`, the first k common shingles of two sets lie in both
   prefixes of size - t + k shingles, so a set with fewer than k prefix shingles that any other prefix holds has no
   partner. This leaves few sets.
3. Those are put in another order, rarest shingle first, in which a set's first size - t + 1 shingles hold one that a
   partner has there too. The sets that share such a shingle meet at the smallest of them.
4. Each meeting stores its sets in a prefix tree, frequent shingles first, so that like sets share their path. A set
   walks the tree with the overlap so far and leaves a branch when the shingles that remain on either side can't lift
   it to the threshold, when no size in it fits, or when all of it is already connected to the set. Meetings of more
   than MEETING sets are dealt out in blocks, every two of which meet.
5. Links form components; each document gets the smallest id of its component.

A text without words or null has the empty set and links with nothing. With fewer than five words the whole sequence
is the one shingle. Rows with the same id are one document with several sets. Rows without id keep a null component.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.llm.common import cut, held, lower_ascii, table, words, written
from askloom.llm.components import components

SHINGLE = 5
DEEPER = 16
MEETING = 6000
BROADCAST_ROWS = 500_000
#: Heavy shingles that are counted apart, the sketch's counters, and the least rows of a heavy one.
HOT, TRACKED, HOT_ROWS = 500, 10_000, 1000


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS narrow rows. df is written or checkpointed."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shingled(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with s: the hashes of the distinct shingles, rising."""
    own = docs.withColumn("_w", held(F.transform(words(lower_ascii(F.col(text).cast("string"))), lambda w: F.xxhash64(w))))
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - SHINGLE), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)]))
    own = own.withColumn("_g", F.when(F.size("_w") >= SHINGLE, grams).when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>")))
    return own.withColumn("s", held(F.sort_array(F.array_distinct("_g")))).drop("_w", "_g")


def need(n: Column) -> Column:
    """The least overlap of a set of n shingles with any partner: 4/5 of n, rounded up."""
    return F.floor((4 * n + 4) / 5).cast("int")


class Node:
    __slots__ = ("run", "held", "next", "docs", "least", "most", "longest", "one")

    def __init__(self, run: list[int]) -> None:
        self.run, self.held = run, frozenset(run)
        self.next: dict[int, Node] = {}
        self.docs: list[int] = []
        self.least, self.most, self.longest, self.one = 1 << 60, 0, 0, -1

    def below(self, size: int, length: int, doc: int, same: bool) -> None:
        """Bounds of the sizes and path lengths in this branch; one: any document of it, or -2 if not all are connected."""
        self.one = doc if self.one == -1 else self.one if same else -2
        self.least, self.most, self.longest = min(self.least, size), max(self.most, size), max(self.longest, length)


def tree_join(sizes: list[int], sets: list[np.ndarray]) -> list[int]:
    """For each set the index of the first set of its component, under 9 * overlap >= 4 * (size + size)."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ranks, shared = place[inverse], counts[inverse] > 1
    stops = np.cumsum([len(s) for s in sets])
    top = list(range(len(sets)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    root = Node([])
    for x in sorted(range(len(sets)), key=lambda i: sizes[i]):
        a, b = stops[x] - len(sets[x]), stops[x]
        path = np.sort(ranks[a:b][shared[a:b]]).tolist()
        own, size, length = set(path), sizes[x], len(path)
        waiting = [(root, 0, 0)]
        while waiting:
            node, overlap, depth = waiting.pop()
            if 5 * node.most < 4 * size or node.one >= 0 and find(node.one) == find(x):
                continue
            if node.run:
                overlap += len(own & node.held)
                depth += len(node.run)
                left = length - bisect_right(path, node.run[-1])
                if 9 * (overlap + min(node.longest - depth, left)) < 4 * (size + node.least):
                    continue
            for y in node.docs:
                if find(y) != find(x) and 9 * overlap >= 4 * (size + sizes[y]):
                    p, q = sorted((find(x), find(y)))
                    top[q] = p
            waiting += [(n, overlap, depth) for n in node.next.values()]
        # x goes into the tree
        node, at = root, 0
        while True:
            node.below(size, length, x, node.one >= 0 and find(node.one) == find(x))
            if at == length:
                node.docs.append(x)
                break
            child = node.next.get(path[at])
            if child is None:
                child = node.next[path[at]] = Node(path[at:])
                child.below(size, length, x, True)
                child.docs.append(x)
                break
            same, run = 0, child.run
            while same < len(run) and at + same < length and run[same] == path[at + same]:
                same += 1
            if same < len(run):  # the child's run is parted
                upper = Node(run[:same])
                upper.least, upper.most, upper.longest, upper.one = child.least, child.most, child.longest, child.one
                child.run, child.held = run[same:], frozenset(run[same:])
                upper.next[child.run[0]] = child
                node.next[path[at]] = upper
                child = upper
            node, at = child, at + same
    first: dict[int, int] = {}
    return [first.setdefault(find(i), i) for i in range(len(sets))]


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """One meeting: links of every set with the smallest number of its component here."""
    pdf = pdf.drop_duplicates("rep").sort_values("rep")
    reps = pdf["rep"].to_numpy()
    to = tree_join(pdf["n"].tolist(), [np.asarray(s, np.int64) for s in pdf["s"]])
    out = pd.DataFrame({"a": reps, "b": reps[to]})
    return out[out.a != out.b]


def heavy(rows: DataFrame) -> list[int]:
    """The numbers g that most rows have, as far as HOT_ROWS or more seem to have them: at most HOT, found by a sketch of
    TRACKED counters with partial aggregates. What it misses has under 1/HOT of all rows."""
    found = rows.agg(F.expr(f"approx_top_k(g, {HOT}, {TRACKED})").alias("x")).first()["x"] or []
    return [r["item"] for r in found if r["count"] >= HOT_ROWS]


def by_number(rows: DataFrame, name: str, total: Column) -> DataFrame:
    """rows with `name`: the aggregate `total` over all rows with the same g. Heavy numbers are aggregated by parts, into at
    most HOT values that go into the plan, so their rows never meet in one task; all others take one shuffle. rows are read
    several times: they come from a file."""
    hot = heavy(rows)
    out = (rows.where(~F.col("g").isin(hot)) if hot else rows).withColumn(name, total.over(Window.partitionBy("g")))
    if not hot:
        return out
    warm = rows.where(F.col("g").isin(hot))
    held_by = warm.groupBy("g").agg(total.alias("v")).collect()
    values = F.map_from_arrays(F.array(*[F.lit(r["g"]) for r in held_by]), F.array(*[F.lit(r["v"]) for r in held_by]))
    return out.unionByName(warm.withColumn(name, F.element_at(values, F.col("g"))))


def shared(rows: DataFrame) -> DataFrame:
    """rows with df, the number of rows with the same g, where that is over one."""
    return by_number(rows, "df", F.count("*")).where("df > 1")


def prefix(s: Column) -> Column:
    """The first shingles of a set, of which step 2 wants some shared."""
    n = F.size(s)
    return F.slice(s, 1, F.least(n, n - need(n) + F.greatest(F.lit(1), F.floor(n / DEEPER)).cast("int")))


def candidates(reps: DataFrame) -> DataFrame:
    """rep of the sets (rep, n, p: the prefix) that step 2 leaves."""
    least = F.greatest(F.lit(1), F.floor(need(F.col("n")) / DEEPER)).cast("int")
    rows = shared(reps.where("n > 0").select("rep", least.alias("least"), F.explode("p").alias("g")))
    return rows.groupBy("rep", "least").agg(F.count("*").alias("k")).where("k >= least").select("rep")


def meetings(sets: DataFrame) -> DataFrame:
    """at, i, j, rep: which sets (rep, n, s) meet where, by step 3. s has the shingles that any other has, rarest first."""
    p = F.col("n") - need(F.col("n")) + 1 - (F.col("n") - F.size("s"))
    rows = shared(sets.where(p > 0).select("rep", F.explode(F.slice("s", 1, F.least(p, F.size("s")))).alias("g")))
    rows = cut(rows.select("g", "rep"))
    pairs = cut(by_number(rows, "at", F.min("rep")).select("at", "rep").distinct())
    size = pairs.groupBy("at").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("blocks"))
    placed = pairs.join(size, "at").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("at", "rep", "mine", others).select("at", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep")


def link(sets: DataFrame) -> DataFrame:
    """a, b: links between the sets (rep, n, s) that connect the same sets as all links do."""
    sets = written(sets, "few")
    rows = shared(sets.select("rep", "n", F.explode("s").alias("g")))
    sets = rows.groupBy("rep", "n").agg(F.sort_array(F.collect_set(F.struct("df", "g"))).alias("x"))  # rows that repeat count once
    sets = written(sets.select("rep", "n", F.transform("x", lambda x: x["g"]).alias("s")), "sets")
    met = meetings(sets).join(sets, "rep")
    return met.groupBy("at", "i", "j").applyInPandas(_meet, "a long, b long").distinct()


CLASS = ["n", "k1", "k2"]


def numbered() -> Column:
    """The number of a set: an id with several texts has several."""
    return F.xxhash64(F.lit(8), "id", *CLASS)


def classed(own: DataFrame) -> DataFrame:
    """own (key, id, t) with s, its size n, and two hashes of it instead of t."""
    return shingled(own, "t").drop("t").withColumns({"n": F.size("s"), "k1": F.xxhash64("s"), "k2": F.xxhash64(F.lit(7), F.col("s"))})


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, n_shingles, component_id. All texts are cut to shingles once, those of step 3 again."""
    own = docs.select(F.col(key).alias("key"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    info = written(classed(own).select("key", "id", *CLASS, prefix(F.col("s")).alias("p")), "shingles")
    some = info.where("n > 0 and id is not null")
    copied = cut(some.groupBy(*CLASS).agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    inner = cut(some.join(bounded(copied), CLASS).where("id <> rep").select("id", "rep", *CLASS).distinct())
    others = bounded(inner.select("id", *CLASS))
    left = some.join(others, ["id", *CLASS], "left_anti").withColumn("rep", numbered())
    few = cut(candidates(left.select("rep", "n", "p")).join(left.select("rep", "id").distinct(), "rep"))
    again = classed(own.join(bounded(few.select(F.col("id").alias("few"))), F.col("id") == F.col("few"), "left_semi")).withColumn("rep", numbered())
    sets = link(again.join(bounded(few.select("rep")), "rep", "left_semi").select("rep", "n", "s"))
    ids = lambda x, y: bounded(few.select(F.col("rep").alias(x), F.col("id").alias(y)))
    links = sets.join(ids("a", "x"), "a").join(ids("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    ends = bounded(components(links.unionByName(inner.select(F.col("id").alias("a"), F.col("rep").alias("b")))))
    out = info.select("key", "id", "n").join(ends.select(F.col("a").alias("id"), F.col("b").alias("to")), "id", "left")
    return out.select(F.col("key").alias(key), F.col("n").cast(T.LongType()).alias("n_shingles"), F.coalesce("to", "id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, one of those with equal ids, and all without id,
    with the columns they had."""
    to = join_documents(docs, key, text).where(F.col("component_id") != F.col(key)).select(F.col(key).cast("long").alias("_gone")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("_key"))
    left = packed.join(bounded(cut(to)), F.col("_key") == F.col("_gone"), "left_anti")
    twice = cut(docs.groupBy(F.col(key).cast("long").alias("_twice")).agg(F.count("*").alias("n")).where("n > 1 and _twice is not null").select("_twice"))
    if not twice.isEmpty():
        same = F.col("_key") == F.col("_twice")
        left = left.join(bounded(twice), same, "left_anti").unionByName(left.join(bounded(twice), same, "left_semi").dropDuplicates(["_key"]))
    return left.select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


ORACLE = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY doc_id),
    link AS (
      SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM g p JOIN g q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
      JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 9 * x.o >= 4 * (p.n + q.n)),
    reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
    FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id"""
