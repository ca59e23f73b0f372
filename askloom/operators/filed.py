"""Sparse vectors in files by block, written once: a task that compares two blocks reads them, so rows are never copied for
each block that they meet, and disk grows with the vectors and not with their pairs.

A file number holds the blocks (group, number) of one hash. Term counts lie there as numbers of a vocabulary, which has its
idf beside it, with the norm of each row; weights are made when a block is read. Other vectors lie there as they are. The
folder is that of `spark.checkpoint.dir`, in any store that pyarrow opens.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from askloom.operators import blocks as B
from askloom.storage import Rounds

#: Groups that are broadcast, terms of a vocabulary that a worker holds.
GROUPS, TERMS = 10_000, 1 << 22
#: Tiles of blocks a side for each group at least, rows of best lists held for a tile's side at most.
BANDS, HELD = 6, 1 << 22


@dataclass
class Filed:
    """Vectors in files: the folder, how many numbers, blocks of a group as (grp, n), kinds of columns, the vocabulary's
    folder."""

    path: str
    files: int
    sizes: DataFrame
    kinds: dict[str, str]
    idf: str | None = None


def freed(spark: SparkSession) -> None:
    """Has the driver notice that tables of shuffles are no longer used, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filed(rows: DataFrame, within: str, counted: DataFrame | None = None, idf: str | None = None, size: int | None = None) -> Filed:
    """Writes rows (id, within, terms, w), (id, within, terms, tf, norm) with idf, or (id, within) with any columns. counted: rows with `within`, not fewer
    than those of each group, where they are cheaper to count. Null groups go."""
    store = Rounds(rows.sparkSession)
    sizes = (counted or rows).where(F.col(within).isNotNull()).groupBy(F.col(within).alias("grp")).agg(F.ceil(F.count("*") / (size or B.SPARSE_ROWS)).cast("int").alias("n"))
    sizes = store.put("sizes", sizes)
    n_groups, n_blocks = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    files = 2 * n_blocks + 1
    dealt = rows.withColumnRenamed(within, "grp").join(F.broadcast(sizes) if n_groups <= GROUPS else sizes, "grp")
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    dealt = dealt.withColumn("file", F.pmod(F.xxhash64("grp", "blk"), F.lit(files)).cast("int"))
    path = f"{store.folder}/vectors"
    dealt.repartition(min(files, max(n_blocks, 1)), "file").sortWithinPartitions("file", "grp", "blk").write.partitionBy("file").option("compression", "zstd").parquet(path)
    freed(rows.sparkSession)
    return Filed(path, files, sizes, dict(dealt.drop("blk", "file").dtypes), idf)


@lru_cache(1)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order, and their idf."""
    found = opened(path).to_table(columns=["term", "idf"])
    term, idf = found["term"].to_numpy(), found["idf"].to_numpy()
    order = np.argsort(term)
    return term[order], idf[order]


def opened(path: str) -> ds.Dataset:
    store, at = fs.FileSystem.from_uri(path)
    return ds.dataset([x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet")], format="parquet", filesystem=store)


class Shelf:
    """Blocks of a Filed as a task reads them."""

    def __init__(self, path: str, idf: str | None):
        self.path, self.idf, self.held = path, idf, (None, None)

    def block(self, file: int, grp: pa.Scalar, blk: int, columns: list[str] | None = None) -> pa.Table:
        """The rows (id, terms, w) of a block by id; columns: only these, as they lie there."""
        key = (file, grp.as_py(), blk)
        if columns is None and self.held[0] == key:
            return self.held[1]
        store, at = fs.FileSystem.from_uri(f"{self.path}/file={file}")
        if grp.as_py() is None or store.get_file_info(at).type == fs.FileType.NotFound:
            self.held = (key, None) if columns is None else self.held
            return None
        own = opened(f"{self.path}/file={file}").to_table(columns=columns or None, filter=(ds.field("grp") == grp) & (ds.field("blk") == blk))
        if columns:
            return own
        own = own.take(pa.array(np.argsort(own["id"].to_numpy(), kind="stable")))  # equal similarities stand by id
        self.held = key, self.weighed(own)
        return self.held[1]

    def weighed(self, own: pa.Table) -> pa.Table:
        if self.idf is None:
            return own.drop_columns(["grp", "blk"])
        terms = own["terms"].combine_chunks()
        code, tf = terms.flatten().to_numpy(), own["tf"].combine_chunks().flatten().to_numpy()
        size = pc.list_value_length(terms).to_numpy()
        w = (1 + np.log(tf)) * vocabulary(self.idf)[1][code]
        w /= np.repeat(own["norm"].to_numpy(), size)
        return pa.table({"id": own["id"], "terms": terms, "w": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(w))})


def coded(lists: DataFrame, keys: list[str], idf: str) -> DataFrame:
    """keys, terms (numbers of the vocabulary), tf, norm of documents (keys, x: terms with tf); unknown terms go, and documents
    that have none left."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idfs = vocabulary(idf)
        for part in parts:
            x = part["x"]
            flat = x.flatten()
            term, tf = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("term", "tf"))
            at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            keep = known[at] == term if len(known) else np.zeros(len(term), bool)
            row = np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))[keep]
            at, tf = at[keep].astype(np.int32), tf[keep]
            norm = np.sqrt(np.bincount(row, ((1 + np.log(tf)) * idfs[at]) ** 2, len(x)))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x))))).astype(np.int32)
            out = pa.RecordBatch.from_arrays([*(part[c] for c in keys), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(tf)), pa.array(norm)], [*keys, "terms", "tf", "norm"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    kind = ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in keys)
    return lists.mapInArrow(run, f"{kind}, terms array<int>, tf array<int>, norm double")


def attached(pairs: DataFrame, within: str, *sides: tuple[str, Filed, dict[str, str]]) -> DataFrame:
    """pairs with columns of files, null where these lack the key: for each side its key in pairs, the files and their columns
    with new names. Rows of pairs are shuffled, what is attached is read in the tasks. Pairs of two sides read a block of the
    second for each block of the first."""
    own, order = pairs, []
    for k, (key, files, _) in enumerate(sides):
        sizes = files.sizes.select(F.col("grp").alias(f"_g{k}"), F.col("n").alias(f"_n{k}"))
        own = own.join(F.broadcast(sizes) if sizes.limit(GROUPS + 1).count() <= GROUPS else sizes, F.col(within) == F.col(f"_g{k}"), "left")
        own = own.withColumn(f"_b{k}", F.pmod(F.xxhash64(key), F.coalesce(f"_n{k}", F.lit(1))).cast("int"))
        own = own.withColumn(f"_f{k}", F.pmod(F.xxhash64(F.col(within), f"_b{k}"), F.lit(files.files)).cast("int")).drop(f"_n{k}", f"_g{k}")
        order += [f"_f{k}", f"_b{k}"]
    own = own.repartition(max(own.sparkSession.sparkContext.defaultParallelism, sides[0][1].files), "_f0", "_b0").sortWithinPartitions(within, *order)
    made = [(key, files.path, files.idf, list(names)) for key, files, names in sides]
    new = [(name, "array<double>" if c == "w" else files.kinds[c]) for _, files, names in sides for c, name in names.items()]
    kept, own_kinds = pairs.columns, to_arrow_schema(pairs.limit(0).selectExpr("*", *(f"CAST(NULL AS {kind}) AS `{n}`" for n, kind in new)).schema)
    names = [*kept, *(x for x, _ in new)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves = [Shelf(path, idf) for _, path, idf, _ in made]
        for part in parts:
            where = np.stack([part[c].to_numpy() for c in order])
            group = part[within].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(where, axis=1) != 0).any(axis=0) | (np.diff(group) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, part.num_rows], strict=True):
                for at in range(a, b, 256):
                    some = part.slice(at, min(256, b - at))
                    found = []
                    for k, (key, _, _, columns) in enumerate(made):
                        held = shelves[k].block(int(where[2 * k, at]), some[within][0], int(where[2 * k + 1, at]))
                        if held is None:
                            found += [pa.nulls(some.num_rows)] * len(columns)  # typed below
                            continue
                        place = pc.index_in(some[key], value_set=held["id"].combine_chunks())
                        found += [held[c].take(place) for c in columns]
                    found = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(own_kinds.field(n).type) for (n, _), x in zip(new, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), *found], names)

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in [*pairs.dtypes, *((n, k) for n, k in new)])
    return own.mapInArrow(run, kinds)


class Side:
    """The best lists of a tile's blocks: rows are known by their place in a block, partners by their rank among the ids."""

    def __init__(self, k: int):
        self.k, self.found, self.floors = k, {}, {}

    def floor(self, blk: int, rows: int) -> np.ndarray:
        """Of each row the k-th best so far; 0 where there are fewer."""
        return self.floors.get(blk, np.zeros(rows))

    def add(self, blk: int, rows: int, i: np.ndarray, rank: np.ndarray, sims: np.ndarray) -> None:
        if blk in self.found:
            i, rank, sims = (np.concatenate(x) for x in zip(self.found[blk], (i, rank, sims), strict=True))
        i, rank, sims = B.firsts(i, rank, sims, self.k)
        self.found[blk] = i.astype(np.int32), rank.astype(np.int32), sims
        full = np.bincount(i, minlength=rows) == self.k
        self.floors[blk] = np.zeros(rows)
        self.floors[blk][full] = sims[np.flatnonzero(np.append(i[1:] != i[:-1], True) if len(i) else [])][full[np.unique(i)]]


def meet(queries: Filed, pool: Filed, k: int, drop_self: bool, digits: int = 6) -> DataFrame:
    """grp, q, p, sim, scored: of each query the k best of a tile of blocks with any shared term, ties to the smaller p; scored:
    the pairs of the tile whose scores were completed, once a tile, else 0. Where both are one table, two blocks meet once for
    both directions. A tile is a task; a query stands in as many tiles as the pool has bands of blocks."""
    spark, alike = queries.sizes.sparkSession, queries is pool
    bands = max(BANDS, int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism))))
    most = max(1, HELD // (B.SPARSE_ROWS * k))
    wide = lambda c: F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col(c) / bands))).cast("int")
    cut = lambda c, at: F.explode(F.sequence(F.lit(0), F.col(c) - 1, wide(c))).alias(at)
    both = queries.sizes.select("grp", F.col("n").alias("nq")).join(pool.sizes.select("grp", F.col("n").alias("np")), "grp")
    tiles = both.select("*", cut("nq", "qa")).select("*", cut("np", "pa"))
    tiles = tiles.where("qa <= pa") if alike else tiles
    file = lambda n, at: F.transform(F.sequence(at, F.least(F.col(n), at + wide(n)) - 1), lambda b: F.struct(b.alias("blk"), F.pmod(F.xxhash64("grp", b), F.lit((queries if n == "nq" else pool).files)).cast("int").alias("file")))
    tiles = tiles.select("grp", file("nq", F.col("qa")).alias("qs"), file("np", F.col("pa")).alias("ps"))
    tiles = Rounds(spark).put("tiles", tiles)
    n_tiles = tiles.count()
    made = ((queries.path, queries.idf), (pool.path, pool.idf))

    def ranked(shelf: Shelf, grp, some: list) -> tuple[pa.Array, dict]:
        """The ids of blocks in order, and of each block its rows' ranks."""
        parts = [(x["blk"], own["id"].combine_chunks()) for x in some if (own := shelf.block(x["file"], grp, x["blk"], ["id"])) is not None]
        if not parts:
            return None, {}
        every = pa.concat_arrays([x for _, x in parts])
        order = np.argsort(every.to_numpy(zero_copy_only=False), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        stops = np.cumsum([len(x) for _, x in parts])
        return every.take(pa.array(order)), {b: np.sort(rank[stop - len(x) : stop]) for (b, x), stop in zip(parts, stops, strict=True)}

    def tile(grp, qs: list, ps: list) -> Iterator[pa.RecordBatch]:
        shelves = Shelf(*made[0]), Shelf(*made[1])
        diagonal = alike and qs == ps
        ids, ranks = zip(*(ranked(s, grp, x) for s, x in zip(shelves, (qs, ps), strict=True)), strict=True)
        there = Side(k)
        back = there if diagonal else Side(k)
        scored = 0
        for x in qs:
            left = shelves[0].block(x["file"], grp, x["blk"])
            for y in ps:
                a, b = x["blk"], y["blk"]
                if diagonal and b < a:
                    continue
                right = shelves[1].block(y["file"], grp, b)
                if left is None or right is None or not left.num_rows or not right.num_rows:
                    continue
                two = alike and a != b
                floors = there.floor(a, left.num_rows), back.floor(b, right.num_rows)
                found = B.sparse_best(left, right, k, "id" if drop_self else None, digits, two, floors)
                for one, side, blk, rows, rank in zip(found if two else (found,), (there, back), (a, b), (left.num_rows, right.num_rows), (ranks[1][b], ranks[0][a]), strict=False):
                    side.add(blk, rows, one[0], rank[one[1]], one[2])
                    scored += one[3]
        for side, own, other, all_own in ((there, ids[0], ids[1], ranks[0]), (back, ids[1], ids[0], ranks[1])):
            for blk, (i, rank, sims) in side.found.items():
                counted = np.zeros(len(i), np.int64)
                counted[:1], scored = scored, scored if not len(i) else 0
                yield pa.RecordBatch.from_arrays([pa.repeat(grp, len(i)), own.take(pa.array(all_own[blk][i])), other.take(pa.array(rank)), pa.array(sims), pa.array(counted)], ["grp", "q", "p", "sim", "scored"])
            if diagonal:
                break

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for grp, qs, ps in zip(part["grp"], part["qs"].to_pylist(), part["ps"].to_pylist(), strict=True):
                yield from tile(grp, qs, ps)

    kind = f"grp {queries.kinds['grp']}, q {queries.kinds['id']}, p {pool.kinds['id']}, sim double, scored long"
    return tiles.repartition(max(1, min(3 * n_tiles, 4096)), "grp", "qs", "ps").mapInArrow(run, kind)


def near(files: Filed, least: float, digits: int) -> DataFrame:
    """grp, q, p, sim of all pairs of a group with a dot product, rounded, of at least `least`, each with itself too. Two blocks
    meet once, in a task that reads them; pairs below the bound never leave it."""
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    cells = files.sizes.select("grp", "n", every.alias("a")).select("grp", "a", every.alias("b")).where("a <= b")
    cells = cells.select("grp", *[x for c in "ab" for x in (c, F.pmod(F.xxhash64("grp", c), F.lit(files.files)).cast("int").alias(f"f{c}"))])
    n_cells = cells.count()
    path, idf, kind = files.path, files.idf, files.kinds

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves = Shelf(path, idf), Shelf(path, idf)
        for part in parts:
            for grp, a, fa, b, fb in zip(part["grp"], *(part[c].to_pylist() for c in ("a", "fa", "b", "fb")), strict=True):
                left, right = shelves[0].block(fa, grp, a), shelves[1].block(fb, grp, b)
                if left is None or right is None or not left.num_rows or not right.num_rows:
                    continue
                i, j, sims = B.sparse_near(left, right, least, digits)
                q, p = left["id"].combine_chunks().take(pa.array(i)), right["id"].combine_chunks().take(pa.array(j))
                for x, y in ((q, p), (p, q))[: 1 + (a != b)]:
                    yield pa.RecordBatch.from_arrays([pa.repeat(grp, len(x)), x, y, pa.array(sims)], ["grp", "q", "p", "sim"])

    return cells.repartition(max(1, min(3 * n_cells, 4096)), "grp", "a", "b").mapInArrow(run, f"grp {kind['grp']}, q {kind['id']}, p {kind['id']}, sim double")
