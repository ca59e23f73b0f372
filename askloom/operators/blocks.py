"""Exact similarity joins in blocks: both sides of a group are dealt to blocks, every two blocks meet in one task, and only
the best of each row, or those above a bound, leave it. Pairs never become rows of a shuffle, and a group of any size is
spread over as many tasks as it has pairs of blocks. Dense vectors meet as a matrix product; sparse ones as a matrix
product of their common terms and an inverted index of the rare ones, in single precision, and the pairs that this leaves
are scored exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENSE_ROWS, SPARSE_ROWS, STRIPE = 4096, 8192, 512
#: Cells of a stripe of sparse scores, products of exact scores held at once.
CELLS, PRODUCTS = 1 << 22, 1 << 19
#: Products of rare terms, and the sums that they go to, held at once.
MET = 1 << 16
#: Groups of cells of a row for each of the k best; only their maxima are ordered.
GROUPS = 8
#: The least score in single precision above 0.
TINY = np.float32(1e-45)
#: Terms are dense columns, up to so many, where this share of all pairs has them on both sides.
HEAD, DENSE = 1024, 0.006
Scores = Callable[[pa.Table, pa.Table], np.ndarray]


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """A matrix of unit rows from lists of one length; a null or zero vector stays zero."""
    lists = column.combine_chunks()
    size = max((len(x) for x in lists.slice(0, len(lists)) if x.is_valid), default=0) if lists.null_count else (len(lists[0]) if len(lists) else 0)
    out = np.zeros((len(lists), size))
    out[~lists.is_null().to_numpy(zero_copy_only=False)] = np.asarray(lists.flatten(), float).reshape(-1, size) if size else 0.0
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def dense_scores(left: pa.Table, right: pa.Table) -> np.ndarray:
    return unit_rows(left["vec"]) @ unit_rows(right["vec"]).T


def flat(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first posting of each row (and the end), the terms, the weights."""
    terms = side["terms"].combine_chunks()
    begin = terms.offsets.to_numpy()
    return begin - begin[0], terms.flatten().to_numpy(), side["w"].combine_chunks().flatten().to_numpy().astype(float, copy=False)


class Met:
    """Two blocks of sparse rows over the terms they share. The terms in many rows of both are columns of a dense matrix in
    single precision; the others' products are added row by row from the runs of postings. That gives all scores to within
    `slack` of themselves, as weights are not below 0; the pairs that matter are then scored exactly."""

    def __init__(self, left: pa.Table, right: pa.Table):
        made = [flat(left), flat(right)]
        if any(len(w) and w.min() < 0 for _, _, w in made):
            raise ValueError("weights below 0")
        cut = len(made[0][1])
        code = pa.array(np.concatenate((made[0][1], made[1][1]))).dictionary_encode().indices.to_numpy()
        n = int(code.max(initial=-1)) + 1
        held = [np.bincount(x, minlength=n) for x in (code[:cut], code[cut:])]
        shared = (held[0] > 0) & (held[1] > 0)
        number = (np.cumsum(shared) - 1).astype(np.int32)
        self.sides = []
        for (begin, _, w), term in zip(made, (code[:cut], code[cut:]), strict=True):
            here = shared[term]
            self.sides.append((np.concatenate(([0], np.cumsum(here)))[begin], number[term[here]], w[here]))
        self.n, self.rows = int(shared.sum()), (left.num_rows, right.num_rows)
        n_left, n_right = held[0][shared], held[1][shared]
        cost = n_left * n_right
        common = np.flatnonzero(cost > DENSE * self.rows[0] * self.rows[1])
        common = common[np.argsort(-cost[common], kind="stable")[:HEAD]]
        self.head = np.full(self.n, -1, np.int32)
        self.head[common] = np.arange(len(common))
        self.dense = self.columns(1, 0, right.num_rows).T.copy()
        begin, term, w = self.sides[1]
        tail = self.head[term] < 0
        order = np.argsort(term[tail], kind="stable")
        self.n_post = np.where(self.head < 0, n_right, 0)
        self.first = np.cumsum(self.n_post) - self.n_post
        self.post = np.repeat(np.arange(right.num_rows), np.diff(begin))[tail][order], w[tail][order]
        begin, term, w = self.sides[0]
        tail = self.head[term] < 0
        self.asked = np.concatenate(([0], np.cumsum(tail)))[begin], term[tail], w[tail]
        met = int(self.n_post[self.asked[1]].sum())
        self.step = max(1, min(MET * self.rows[0] // max(met, 1), MET // max(right.num_rows, 1)))
        self.longest = max(int(np.diff(b).max(initial=1)) for b, _, _ in self.sides)
        self.slack = (self.longest + 8) * 2.0**-22

    def columns(self, side: int, a: int, b: int) -> np.ndarray:
        """The common terms' weights of the rows a..b as a dense matrix."""
        begin, term, w = self.sides[side]
        out = np.zeros((b - a, int(self.head.max(initial=-1)) + 1), np.float32)
        at = self.head[term[begin[a] : begin[b]]]
        keep = at >= 0
        out[np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))[keep], at[keep]] = w[begin[a] : begin[b]][keep]
        return out

    def scores(self, a: int, b: int) -> np.ndarray:
        """Scores of the left rows a..b with all right rows, in single precision."""
        out = self.columns(0, a, b) @ self.dense
        begin, term, w = self.asked
        rows, weights = self.post
        for at in range(a, b, self.step):  # the sums of a few rows stay in the cache
            to = min(at + self.step, b)
            mine = slice(begin[at], begin[to])
            runs = self.n_post[term[mine]]
            stops = np.cumsum(runs)
            if not len(runs):
                continue
            where = np.repeat(self.first[term[mine]] - stops + runs, runs)
            where += np.arange(stops[-1])
            products = np.repeat(w[mine], runs)
            products *= weights[where]
            cells = rows[where]
            if to - at > 1:
                cells += np.repeat(np.repeat(np.arange(to - at) * self.rows[1], np.diff(begin[at : to + 1])), runs)
            out[at - a : to - a] += np.bincount(cells, products, (to - at) * self.rows[1]).reshape(to - at, -1)
        return out

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The dot products of the pairs (i, j), i in order, in double precision; each pair shares a term."""
        out, held = np.zeros(len(i)), np.zeros(self.n)
        (lb, lt, lw), (rb, rt, rw) = self.sides
        begin, end, size = rb[j].tolist(), rb[j + 1].tolist(), rb[j + 1] - rb[j]
        edges, step = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i)).tolist(), max(1, PRODUCTS // self.longest)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = slice(lb[i[a]], lb[i[a] + 1])
            held[lt[own]] = lw[own]
            for c in range(a, b, step):
                some = slice(c, min(c + step, b))
                parts = [slice(x, y) for x, y in zip(begin[some], end[some], strict=True)]
                met = held[np.concatenate([rt[x] for x in parts])] * np.concatenate([rw[x] for x in parts])
                out[some] = np.add.reduceat(met, np.cumsum(size[some]) - size[some])
            held[lt[own]] = 0.0
        return out


def codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; -1 and -2 for nulls, which equal nothing."""
    both = pa.chunked_array([*left.chunks, *right.chunks], left.type).combine_chunks().dictionary_encode()
    found = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    a, b = found[: len(left)], found[len(left) :]
    return a, np.where(b < 0, -2, b)


def firsts(i: np.ndarray, j: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each i, ties to the smaller j."""
    best = np.lexsort((j, -sims, i))
    i, j, sims = i[best], j[best], sims[best]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], sims[keep]


def peaks(cells: np.ndarray, k: int) -> tuple[np.ndarray, int, int]:
    """The maxima of n groups of each row's cells (g, g + n, ...) and the cells left over, n, and the cells of a group. The
    k-th greatest of them is not above the row's k-th greatest cell."""
    n = max(16, GROUPS * k)
    size = cells.shape[1] // n
    if size < 2:
        return cells, 0, 0
    return np.concatenate((cells[:, : n * size].reshape(len(cells), size, n).max(axis=1), cells[:, n * size :]), axis=1), n, size


def reaching(cells: np.ndarray, found: tuple[np.ndarray, int, int], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of at least their row's bound, by row; only groups whose maximum reaches it are looked at."""
    tops, n, size = found
    i, g = np.nonzero(tops >= bound[:, None])
    whole = g < n
    j = np.concatenate(((g[whole][:, None] + n * np.arange(size)).ravel(), g[~whole] + n * (size - 1) if n else g))
    i = np.concatenate((np.repeat(i[whole], size), i[~whole]))
    keep = cells[i, j] >= bound[i]
    i, j = i[keep], j[keep]
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def sparse_best(left: pa.Table, right: pa.Table, k: int, differ: str | None, digits: int, both: bool = False, floors: tuple[np.ndarray, np.ndarray] | None = None) -> tuple:
    """Of each left row the right rows that can be among its k best by the dot product of (terms, w >= 0) lists, with their
    exact scores, and the number of pairs that were scored exactly: those whose score in single precision is not below the
    row's k-th best by more than the precision. Weights below 0 are no tf-idf weights and raise an error.
    both: two results, the second of each right row (right, left, scores, number), from the same scores.
    floors: of each left and right row an exact score that its k best reach elsewhere; what is less need not be found."""
    met = Met(left, right)
    barred = codes(left[differ], right[differ]) if differ else None
    if barred and not np.isin(*barred).any():
        barred = None
    least = lambda kth: (kth * (1 - met.slack) - 2 * 10.0**-digits).astype(np.float32)
    stripe = max(1, CELLS // max(right.num_rows, 1))
    none = np.empty(0, int), np.empty(0, int), np.empty(0)
    found, scored = [none], 0
    floor = [least(x) for x in floors] if floors else [np.zeros(n, np.float32) for n in met.rows]
    back, top = [none], np.zeros((right.num_rows, k), np.float32)  # of each right row k of the best so far
    for a in range(0, left.num_rows, stripe):
        b = min(a + stripe, left.num_rows)
        out = met.scores(a, b)
        if barred:
            out[barred[0][a:b, None] == barred[1][None, :]] = 0.0
        tops = peaks(out, k)
        bound = np.zeros(b - a, np.float32)
        if right.num_rows > k:
            at = tops[0].shape[1] - k
            bound = least(np.partition(tops[0], at, axis=1)[:, at])
        i, j = reaching(out, tops, np.maximum(np.maximum(bound, floor[0][a:b]), TINY))
        scored += len(i)
        found.append(firsts(i + a, j, np.round(met.exact(i + a, j), digits), k))
        if both:
            tops = peaks(out.T, k)
            top = np.concatenate((top, tops[0]), axis=1)
            top = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
            j, i = reaching(out.T, tops, np.maximum(np.maximum(least(top.min(axis=1)), floor[1]), TINY))
            back.append((i + a, j, out[i, j]))
    there = *(np.concatenate([x[c] for x in found]) for c in range(3)), scored
    if not both:
        return there
    i, j, near = (np.concatenate([x[c] for x in back]) for c in range(3))
    keep = near >= least(top.min(axis=1))[j]
    order = np.argsort(i[keep], kind="stable")
    i, j = i[keep][order], j[keep][order]
    return there, (*firsts(j, i, np.round(met.exact(i, j), digits), k), len(i))


def sparse_near(left: pa.Table, right: pa.Table, least: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs whose exact score, rounded, is at least `least`."""
    met = Met(left, right)
    stripe = max(1, CELLS // max(right.num_rows, 1))
    bound = np.float32((least - 10.0**-digits) * (1 - met.slack))
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for a in range(0, left.num_rows, stripe):
        i, j = np.nonzero(met.scores(a, min(a + stripe, left.num_rows)) >= bound)
        sims = met.exact(i + a, j)
        keep = np.round(sims, digits) >= least
        found.append((i[keep] + a, j[keep], sims[keep]))
    return tuple(np.concatenate([x[c] for x in found]) for c in range(3))


def dealt(queries: DataFrame, pool: DataFrame, within: str, rows: int, whole_pool: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (_whole, _g, _qb, _pb) in which a query and a pool row meet; rows are copied once per block
    of the other side. whole_pool: queries of a group without pool rows meet the whole pool."""
    pool = pool.select(*[F.col(c).alias(c) for c in pool.columns])  # both sides may be one table
    group = F.col(within)
    has = pool.groupBy(group.alias("_g")).agg(F.count("*").alias("_np"))
    q = queries.join(has, group.eqNullSafe(F.col("_g")) if whole_pool else group == F.col("_g"), "left").withColumn("_whole", F.col("_np").isNull())
    q = q.drop("_np") if whole_pool else q.where("_np IS NOT NULL").drop("_np")
    q = q.withColumn("_g", F.when(~F.col("_whole"), group))
    p = pool.withColumns({"_g": group, "_whole": F.lit(False)})
    if whole_pool:
        p = p.unionByName(pool.withColumns({"_g": F.lit(None).cast(pool.schema[within].dataType), "_whole": F.lit(True)}))
    sizes = []
    for side, name in ((q, "_nq"), (p, "_np")):
        sizes.append(side.groupBy("_whole", "_g").agg(F.ceil(F.count("*") / rows).cast("int").alias(name)).withColumnsRenamed({"_whole": "_w_", "_g": "_g_"}))
    both = sizes[0].join(sizes[1].withColumnsRenamed({"_w_": "_w2", "_g_": "_g2"}), (F.col("_w_") == F.col("_w2")) & F.col("_g_").eqNullSafe(F.col("_g2"))).select("_w_", "_g_", "_nq", "_np")
    meets = (F.col("_whole") == F.col("_w_")) & F.col("_g").eqNullSafe(F.col("_g_"))
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = ["_nq", "_np", "_w_", "_g_"]
    return q.join(both, meets).withColumns({"_qb": block("_nq"), "_pb": every("_np")}).drop(*own), p.join(both, meets).withColumns({"_pb": block("_np"), "_qb": every("_nq")}).drop(*own)


def in_blocks(queries: DataFrame, pool: DataFrame, within: str, score: Scores, rows: int, k: int | None = None, least: float | None = None, differ: str | None = None, whole_pool: bool = False, digits: int = 6) -> DataFrame:
    """within, q, p, sim of (id, within, ...) rows: of each query the k best of a block (all if None) whose sim, rounded,
    is at least `least`; ties go to the smaller p. Zero similarities count only where `least` is None.
    differ: a column in which the two must not be equal, as id to leave a row itself out."""
    cells = dealt(queries, pool, within, rows, whole_pool)
    kinds = queries.schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        q, p = (x["id"].to_numpy() for x in (left, right))
        order = np.argsort(p, kind="stable")  # so that equal similarities stand by p
        right, p = right.take(pa.array(order)), p[order]
        for a in range(0, left.num_rows, STRIPE):
            part = left.slice(a, STRIPE)
            raw = score(part, right)
            sims = np.round(raw, digits)
            if differ:
                sims[part[differ].to_numpy()[:, None] == right[differ].to_numpy()[None, :]] = -np.inf
            bound = np.full(len(sims), -np.inf if least is None else least)
            if k is not None and sims.shape[1] > k:
                bound = np.maximum(bound, np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k])
            i, j = np.nonzero((sims >= bound[:, None]) & (sims > -np.inf) & (True if least is None else raw != 0))
            best = np.lexsort((j, -sims[i, j], i))
            i, j = i[best], j[best]
            if k is not None and len(i):
                begin = np.searchsorted(i, i)
                keep = np.arange(len(i)) - begin < k
                i, j = i[keep], j[keep]
            out.append(pa.table({"grp": part[within].take(pa.array(i)), "q": pa.array(q[a : a + STRIPE][i]), "p": pa.array(p[j]), "sim": pa.array(sims[i, j])}))
        return pa.concat_tables(out)

    kind = f"grp {kinds[within].dataType.simpleString()}, q {kinds['id'].dataType.simpleString()}, p {pool.schema['id'].dataType.simpleString()}, sim double"
    keys = ["_whole", "_g", "_qb", "_pb"]
    return cells[0].groupBy(*keys).cogroup(cells[1].groupBy(*keys)).applyInArrow(run, kind).withColumnRenamed("grp", within)


def sparse_in_blocks(queries: DataFrame, pool: DataFrame, within: str, k: int, differ: str | None = None, digits: int = 6) -> DataFrame:
    """within, q, p, sim, scored of (id, within, terms, w) rows as filed.meet gives them; differ: id, to leave a row itself out."""
    from askloom.operators.filed import filed, meet

    if differ not in (None, "id"):
        raise ValueError("only a row itself can be left out")
    held = filed(queries, within)
    return meet(held, held if pool is queries else filed(pool, within), k, differ == "id", digits).withColumnRenamed("grp", within)


def sparse_pairs(vectors: DataFrame, least: float, digits: int) -> DataFrame:
    """q, p, sim of all pairs of (id, terms, w) rows with a dot product, rounded, of at least `least`, each with itself too."""
    from askloom.operators.filed import filed, near

    return near(filed(vectors.select("id", "terms", "w", F.lit(0).alias("_all")), "_all"), least, digits).drop("grp")
