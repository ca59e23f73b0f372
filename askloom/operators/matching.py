"""One-to-one assignment by auction: bids and prices are tables, and no group stands in one task.

Bidders are the smaller side of a group, dealt to blocks of at most PAIRS pairs. In a round every block with a bidder who
has no object holds its own auction at the prices of the whole group: a bidder looks at its pairs less the objects'
prices and bids for the best one as much as it beats the second best, plus a step; who held it asks again. Then each
object goes to the highest bidder of all blocks, and the others ask again. A block's prices are never above the group's,
so who wins is content with what it has, as if there were no blocks. Prices only rise and start at zero, so an object
that nobody holds costs nothing: that makes the result right for sides of unequal sizes (prices carried over from coarser
steps, as in epsilon scaling, would not). With a step below resolution / bidders the total is the greatest possible up to
the resolution of the similarities.

Staying alone is worth `alone`; a bidder whose best pair is worth no more stops asking, so missing pairs and groups with
too few partners come to an end. Ties go to the smaller object and the smaller bidder. Of repeated pairs the best
counts; pairs with a null key or similarity go. Null groups are a group. Empty tables give no rows.

Where similarities are cosines of vectors, `one_to_one_vectors` takes the vectors: pairs are no rows anywhere, so memory and
disk grow with the vectors. A bidder keeps the MIND objects in mind that were best at some prices. As prices only rise, all
others stay below a bound, and it looks at the whole row again only when its choice reaches that bound.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.operators.blocks import unit_rows
from askloom.storage import Rounds

RESOLUTION = 1e-6
ROUNDS_MAX = 100_000
#: Pairs of a block, as long as a bidder has no more.
PAIRS = 1 << 21
#: Over vectors: bidders of a block, objects that each keeps in mind, similarities held at once.
BIDDERS, MIND, CELLS = 1 << 15, 128, 1 << 22


def sided(pairs: DataFrame, group: str) -> DataFrame:
    """g, blk, b, o, sim, turned, step: bidders, with their block, and objects; turned where p bids because it is the smaller
    side."""
    g = F.struct(F.col(group).alias("k"))  # a null group is a key like any other
    own = pairs.where("q IS NOT NULL AND p IS NOT NULL AND sim IS NOT NULL").groupBy(g.alias("g"), "q", "p").agg(F.max("sim").cast("double").alias("sim"))
    sizes = own.select("g", "q").distinct().groupBy("g").agg(F.count("*").alias("nq")).join(own.select("g", "p").distinct().groupBy("g").agg(F.count("*").alias("np")), "g")
    sizes = sizes.join(own.groupBy("g").agg(F.ceil(F.count("*") / PAIRS).alias("blocks")), "g")
    own = own.join(sizes, "g").withColumn("turned", F.col("nq") > F.col("np"))
    pick = lambda a, b: F.when(F.col("turned"), F.col(a)).otherwise(F.col(b))
    own = own.withColumn("blk", F.pmod(F.xxhash64(pick("p", "q")), F.col("blocks")).cast("int"))
    return own.select("g", "blk", pick("p", "q").alias("b"), pick("q", "p").alias("o"), "sim", "turned", (RESOLUTION / (1 + F.least("nq", "np"))).alias("step"))


class Auction:
    """A block's auction: it opens with the state of the whole group's holders and ends when nobody asks."""

    def __init__(self, bidders: np.ndarray, objects: np.ndarray, state: pa.Table, alone: float, step: float):
        self.bidders, self.objects, self.alone, self.step = bidders, objects, alone, step
        self.prices, self.holder = np.zeros(len(objects)), np.full(len(objects), -1)
        self.held, self.sims, self.out = np.full(len(bidders), -1), np.zeros(len(bidders)), np.zeros(len(bidders), bool)
        for b, o, price, sim, gone in zip(*(state[c].to_pylist() for c in ("b", "o", "price", "sim", "out")), strict=True):
            i = int(np.searchsorted(bidders, b))
            own = i < len(bidders) and bidders[i] == b
            if own:
                self.out[i] = gone
            if o is not None and (j := int(np.searchsorted(objects, o))) < len(objects) and objects[j] == o:
                self.prices[j] = price
                if own:
                    self.holder[j], self.held[i], self.sims[i] = i, j, sim
        self.asking = np.flatnonzero((self.held < 0) & ~self.out)

    def run(self, look) -> None:
        """look: of a bidder its best object, what that is worth at the prices, the worth of the second best, the similarity."""
        asking = deque(self.asking.tolist())
        while asking:
            i = asking.popleft()
            j, worth, second, sim = look(i)
            if worth <= self.alone:
                self.out[i] = True
                continue
            self.prices[j] += worth - max(second, self.alone) + self.step
            if self.holder[j] >= 0:
                self.held[self.holder[j]] = -1
                asking.append(int(self.holder[j]))
            self.holder[j], self.held[i], self.sims[i] = i, j, sim

    def state(self, g: pa.Scalar, blk: int) -> pa.Table:
        none, n = self.held < 0, len(self.bidders)
        at = lambda x: pa.array(x[self.held] if len(x) else np.zeros(n, x.dtype), mask=none)
        return pa.table({"g": pa.repeat(g, n), "blk": pa.repeat(pa.scalar(blk, pa.int32()), n), "b": pa.array(self.bidders), "o": at(self.objects), "price": at(self.prices), "sim": pa.array(self.sims, mask=none), "out": pa.array(self.out)})


def auction(pairs: pa.Table, state: pa.Table, alone: float) -> pa.Table:
    """The state of a block's bidders after its auction, from its pairs and the state of the whole group's holders."""
    pairs = pairs.sort_by([("b", "ascending"), ("o", "ascending")])
    bidders, begin = np.unique(pairs["b"].to_numpy(), return_index=True)
    objects, at = np.unique(pairs["o"].to_numpy(), return_inverse=True)
    sims, ends = pairs["sim"].to_numpy(), np.append(begin[1:], pairs.num_rows)
    own = Auction(bidders, objects, state, alone, pairs["step"][0].as_py())

    def look(i: int) -> tuple[int, float, float, float]:
        some = at[begin[i] : ends[i]]
        net = sims[begin[i] : ends[i]] - own.prices[some]
        best = int(net.argmax())  # the smallest object of equal ones
        worth, net[best] = net[best], -np.inf
        return some[best], worth, net.max(), sims[begin[i] + best]

    own.run(look)
    return own.state(pairs["g"][0], pairs["blk"][0].as_py())


class Minds:
    """Looks of bidders at all objects of a group over unit rows, exact without a matrix of all pairs."""

    def __init__(self, own: Auction, bids: tuple[np.ndarray, np.ndarray], objects: tuple[np.ndarray, np.ndarray], digits: int):
        self.own, self.digits = own, digits
        (self.begin, self.rows), (self.first, self.there) = bids, objects  # an id may have several vectors
        self.size = min(MIND, len(self.first))
        shape = (len(self.begin) - 1, self.size)
        self.seen, self.sims, self.bound = np.zeros(shape, np.int32), np.zeros(shape), np.full(shape[0], np.inf)
        step = max(1, CELLS // max(len(self.there), 1))
        for a in range(0, len(own.asking), step):
            i = own.asking[a : a + step]
            self.keep(i, self.scored(i))

    def scored(self, i: np.ndarray) -> np.ndarray:
        """The similarities of the bidders i with all objects; -inf where a vector has none."""
        many = np.diff(self.begin)[i]
        at = np.repeat(self.begin[i] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.round(self.rows[at] @ self.there.T, self.digits)
        out[np.isnan(out)] = -np.inf
        if len(self.first) < len(self.there):
            out = np.maximum.reduceat(out, self.first, axis=1)
        return out if len(out) == len(i) else np.maximum.reduceat(out, np.cumsum(many) - many, axis=0)

    def keep(self, i: np.ndarray, sims: np.ndarray) -> None:
        net = sims - self.own.prices
        if self.size < net.shape[1]:
            order = np.argpartition(-net, self.size, axis=1)
            self.bound[i] = np.take_along_axis(net, order[:, self.size : self.size + 1], axis=1)[:, 0]
            best = np.sort(order[:, : self.size], axis=1)
        else:
            self.bound[i] = -np.inf
            best = np.broadcast_to(np.arange(net.shape[1]), net.shape)
        self.seen[i], self.sims[i] = best, np.take_along_axis(sims, best, axis=1)

    def look(self, i: int) -> tuple[int, float, float, float]:
        net = self.sims[i] - self.own.prices[self.seen[i]]
        best = int(net.argmax())
        worth, net[best] = net[best], -np.inf
        second, bound = net.max(), self.bound[i]
        if bound == -np.inf or worth > bound and max(second, self.own.alone) >= bound:
            return self.seen[i, best], worth, second, self.sims[i, best]
        row = self.scored(np.array([i]))
        self.keep(np.array([i]), row)
        net = row[0] - self.own.prices
        best = int(net.argmax())
        worth, net[best] = net[best], -np.inf
        return best, worth, net.max(), row[0, best]


def vector_auction(rows: pa.Table, state: pa.Table, alone: float, digits: int) -> pa.Table:
    """auction() of a block's bidders and all objects of the group, from rows (g, blk, bids, id, vec, step)."""
    if not rows.num_rows or not state.num_rows:
        return pa.table({c: rows[c].slice(0, 0) if c in rows.column_names else state[c].slice(0, 0) for c in state.column_names})
    rows = rows.sort_by([("id", "ascending")])
    units = unit_rows(rows["vec"])
    bids, ids = rows["bids"].to_numpy(zero_copy_only=False), rows["id"].to_numpy()
    bidders, begin = np.unique(ids[bids], return_index=True)
    objects, first = np.unique(ids[~bids], return_index=True)
    own = Auction(bidders, objects, state, alone, rows["step"][0].as_py())
    own.run(Minds(own, (np.append(begin, bids.sum()), units[bids]), (first, units[~bids]), digits).look)
    return own.state(rows["g"][0], rows["blk"][0].as_py())


def settled(state: DataFrame) -> DataFrame:
    """Of all who hold an object the one who pays most keeps it."""
    best = state.where("o IS NOT NULL").groupBy("g", "o").agg(F.max(F.struct(F.col("price").alias("price"), (-F.col("b")).alias("nb"))).alias("x"))
    best = best.select("g", "o", (-F.col("x.nb")).alias("winner"))
    both = state.join(best, ["g", "o"], "left")
    kept = F.col("winner") == F.col("b")
    return both.select("g", "blk", "b", F.when(kept, F.col("o")).alias("o"), F.when(kept, F.col("price")).alias("price"), F.when(kept, F.col("sim")).alias("sim"), "out")


def rounds(store: Rounds, bidders: DataFrame, number: str, held_by) -> DataFrame:
    """The last state, from bidders (g, blk, b): held_by gives the new state of the blocks (g, blk) that ask, from them and what they see."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    state = store.put("state", bidders.select("g", "blk", "b", none(number, "o"), none("double", "price"), none("double", "sim"), F.lit(False).alias("out")))
    for _ in range(ROUNDS_MAX):
        busy = state.where("o IS NULL AND NOT out").select("g", "blk").distinct()
        if busy.isEmpty():
            return state
        seen = busy.join(state.withColumnRenamed("blk", "home"), "g").where("home = blk OR o IS NOT NULL").drop("home")
        made = held_by(busy, seen, state.schema)
        state = store.put("state", settled(state.join(busy, ["g", "blk"], "left_anti").unionByName(made)))
    raise RuntimeError(f"the auction did not end in {ROUNDS_MAX} rounds")


def one_to_one(pairs: DataFrame, group: str, alone: float = -1.0) -> DataFrame:
    """Per group, pairs (q, p, sim) of greatest total similarity with each q and p used once; (group, q, p, sim) with whole
    numbers as q and p."""
    store = Rounds(pairs.sparkSession)
    sides = store.put("pairs", sided(pairs, group))

    def held_by(busy, seen, kind):
        met = sides.join(busy, ["g", "blk"], "left_semi").groupBy("g", "blk").cogroup(seen.groupBy("g", "blk"))
        return met.applyInArrow(lambda left, right: auction(left, right, alone), kind)

    state = rounds(store, sides.select("g", "blk", "b").distinct(), sides.schema["o"].dataType.simpleString(), held_by)
    held = sides.join(state.where("o IS NOT NULL").select("g", "b", "o"), ["g", "b", "o"])
    pick = lambda a, b: F.when(F.col("turned"), F.col(a)).otherwise(F.col(b))
    return held.select(pick("o", "b").alias("q"), pick("b", "o").alias("p"), "sim")


def one_to_one_vectors(left: DataFrame, right: DataFrame, group: str, alone: float = -1.0, digits: int = 6) -> DataFrame:
    """one_to_one of all pairs of left and right rows (group, id, vec) of a group, with their cosine, rounded, as similarity; rows
    with a null group or id go. A block's task reads its bidders and all objects of the group."""
    store = Rounds(left.sparkSession)
    own = lambda x, asks: x.where(F.col(group).isNotNull() & F.col("id").isNotNull()).select(F.struct(F.col(group).alias("k")).alias("g"), F.lit(asks).alias("asks"), "id", "vec")
    both = own(left, True).unionByName(own(right, False))
    n = lambda asks: F.count_distinct(F.when(F.col("asks") == asks, F.col("id")))
    sizes = both.groupBy("g").agg(n(True).alias("nq"), n(False).alias("np")).where("nq > 0 AND np > 0")
    sizes = sizes.select("g", (F.col("nq") > F.col("np")).alias("turned"), F.ceil(F.least("nq", "np") / BIDDERS).cast("int").alias("blocks"), (RESOLUTION / (1 + F.least("nq", "np"))).alias("step"))
    bids = F.col("asks") != F.col("turned")
    blk = F.when(bids, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = store.put("sides", both.join(sizes, "g").select("g", blk.alias("blk"), bids.alias("bids"), "id", "vec", "turned", "step"))

    def held_by(busy, seen, kind):
        met = sides.where("bids").join(busy, ["g", "blk"], "left_semi").unionByName(sides.where("NOT bids").drop("blk").join(busy, "g"))
        return met.groupBy("g", "blk").cogroup(seen.groupBy("g", "blk")).applyInArrow(lambda rows, state: vector_auction(rows, state, alone, digits), kind)

    bidders = sides.where("bids").select("g", "blk", F.col("id").alias("b"), "turned").distinct()
    state = rounds(store, bidders, sides.schema["id"].dataType.simpleString(), held_by)
    held = state.where("o IS NOT NULL").join(bidders.select("g", "turned").distinct(), "g")
    pick = lambda a, b: F.when(F.col("turned"), F.col(a)).otherwise(F.col(b))
    return held.select(pick("o", "b").alias("q"), pick("b", "o").alias("p"), "sim")
