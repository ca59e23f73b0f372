"""LM scoring (op 5) by online logistic context mixing over the bits of words.

A text is its lower-case words and an end token. Each word is coded by decisions, each one bit:
1. Follower: where the two words before it have been seen in other places of the training texts, is the word the one that
   follows them most often there? A yes codes the whole word.
2. Symbol: else the bits of a Huffman code. Symbols are the words that make up 1/TOP of the training tokens or more, for all
   others the class floor(log2 of their count), and one for words that no other place has. In a class the word has its exact
   share of the class.
3. Spelling: of a word that no other place has, the bits of its bytes and a blank, in Huffman codes by the byte before.
Each bit has several predictors. Symbols: hashed contexts of the last symbol, of the last two, and of the last symbol with the
last frequent word. Spelling: of the last two bytes, of three, and of two with the last frequent word. Followers: how often the
candidate followed and others did, and how often candidates were right lately in the text. Log-odds are summed with weights
that a gate selects; a scale and an offset per text, refined as the text goes on, give the final odds. The sum over all bits
is the log10 probability of the text, and bits_per_byte is the total of bits over the bytes.

Training reads all documents whose crc32 of the id is not divisible by FOLDS. What it gathers grows with the texts: exact
counts of all words, and exact counts of all pairs of two words and a follower (48 bits of the context's hash, 16 of the
follower's). Units of about UNIT bytes of a part write their distinct pairs; the pairs are dealt to buckets by hash, as
many as the training tokens ask for, and added up there; each unit gets back one byte for each of its pairs. Contexts of
symbols and bytes come from bounded alphabets, so their hashed tables have a fixed size; tasks write the slots they touch.
A training text is scored as if its own occurrence of each word, pair and bit had not been counted.
Weights are learned online: each block of texts is predicted, then corrects them; the first block of a task corrects them
WARM times before. So scores depend a little on which texts share a partition, but on no threshold of its size.

Null and empty texts have the end token alone. A null id counts as the empty text. An empty table gives no rows; without
training documents all words are spelled with even odds. Repeated rows are scored, and learned from, as often as they occur.
Words are known by 64 bits of a hash: of 10 million distinct words two fall together with odds of 1 to 370,000.
The texts are written once, by the tasks that first read them, and each file is a part: later scans read part by part, so
they don't hang on how Spark splits the input then, nor on the executors that are left. Scores do hang on which texts are in
one part. Tables of bits are added up in a tree of TREE parts a task.
Texts of over UNIT bytes are worked through in parts cut at blanks; contexts of words begin anew there.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.common import shared_dir, table, written

FOLDS = 10
#: Words of 1/TOP of the training tokens are symbols of their own; classes follow from 1024 on.
TOP, UNSEEN, BEGIN, SYMBOLS = 1024, 1024 + 60, 1024 + 61, 1024 + 64
#: Bytes of text whose pairs are held at a time, training tokens a bucket, words a block.
UNIT, SHARE, BLOCK = 1 << 21, 1 << 21, 1 << 16
SLOT_BITS, RANGES, PREDICTORS = 21, 8, 3
#: Parts whose tables of bits are added up at a time; rows of a part read at a time.
TREE, ROWS = 64, 1024
NODE_OF_BYTE = 2048
MASK = (4 << SLOT_BITS) - 1
GATES, WARM, RATE, SQUARE = 76, 4, 0.3, 3
#: Weights before any learning.
START = (0.3, 0.4, 0.3)
#: Steps of the stored log-odds; what each count begins with.
STEPS, PRIOR = 12, 0.4
RATE_SCALE, RATE_OFFSET = 0.3, 0.3
#: Bits after which a text's scale and offset are corrected; later half as many as the bits so far.
REFINE = 128
LEVELS = np.array([0, 1, 2, 3, 5, 9, 17, 65])
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
END_HASH = np.uint64(0x2545F4914F6CDD1D)
_zstd = pa.Codec("zstd", compression_level=1)


def held_out(key: int | None) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == 0


def squeezed(numbers: np.ndarray) -> bytes:
    """Bytes of numbers, compressed by planes; sorted ones are best given as differences."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()
    return len(numbers).to_bytes(8, "little") + _zstd.compress(planes, asbytes=True)


def restored(held: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(held[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(_zstd.decompress(held[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


class Code:
    """Huffman codes, one for each list of counts: for each symbol the inner nodes on its path, their depths, and its bits."""

    def __init__(self, lists: list[list[int]]) -> None:
        nodes, depths, bits, sizes, made = [], [], [], [], {}
        for counts in lists:
            key = tuple(counts) if any(counts) else ()
            if key not in made:
                made[key] = self._paths(counts)
            for path in made[key]:
                sizes.append(len(path))
                nodes += [x[0] for x in path]
                depths += [x[1] for x in path]
                bits += [x[2] for x in path]
        self.sizes = np.array(sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.nodes, self.bits = np.array(nodes), np.array(bits, np.uint8)
        self.depths = np.minimum(depths, 7).astype(np.uint8)

    def packed(self, lift: int) -> np.ndarray:
        """For each place in the flat arrays the step of its node, its depth and its bit in one number."""
        return steps(self.nodes + lift) | self.depths.astype(np.int64) << 40 | self.bits.astype(np.int64) << 48

    @staticmethod
    def _paths(counts: list[int]) -> list[list[tuple[int, int, int]]]:
        heap = [(c + 1, b, None) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        number = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
            number += 1
        paths: list = [None] * len(counts)
        stack = [(heap[0], [])]
        while stack:
            (_, n, kids), path = stack.pop()
            if kids is None:
                paths[n] = path
            else:
                stack += [(kid, [*path, (n - len(counts), len(path), bit)]) for bit, kid in enumerate(kids)]
        return paths

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit of the symbols: its place in the flat arrays, and which symbol it belongs to."""
        sizes = self.sizes[symbols]
        stops = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(symbols)), sizes)
        return np.arange(len(owner)) + (self.begins[symbols] - (stops - sizes)).take(owner), owner


_powers: list[np.ndarray] = []


def hashes(held: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes; stretches rise and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    edges = np.r_[np.searchsorted(starts, np.arange(0, len(held) + 1, 1 << 18)), len(starts)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        low, high = int(starts[a]), int(stops[b - 1])
        n = high - low
        if not _powers or len(_powers[0]) <= n:
            size = 1 << max(19, n.bit_length())
            _powers.clear()
            for base in (0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE.take(held[low:high]) * _powers[0][:n], out=sums[1:])
        x = (sums[stops[a:b] - low] - sums[starts[a:b] - low]) * _powers[1][starts[a:b] - low]
        x = (x ^ x >> np.uint64(31)) * M3
        out[a:b] = x ^ x >> np.uint64(29)
    return out


class Places:
    """Where numbers stand in a sorted, distinct array of well-mixed 64-bit numbers."""

    def __init__(self, held: np.ndarray) -> None:
        self.held = np.append(held, ~np.uint64(0))
        bits = max(1, len(held).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(held, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        at = self.first.take((numbers >> self.shift).astype(np.int64))
        later = np.flatnonzero(self.held.take(at) < numbers)
        while len(later):
            at[later] += 1
            later = later[self.held.take(at[later]) < numbers[later]]
        if (self.held.take(at) != numbers).any():
            raise ValueError("a word or pair that its partition has not written: the input was split anew")
        return at


class Words:
    """What a task knows of its partition's words: counts, hashes and symbols. known: from settings()."""

    def __init__(self, h: np.ndarray, c: np.ndarray, known: dict) -> None:
        order = np.argsort(h)
        self.known, self.h, self.c = known, h[order], c[order]
        self.places = Places(self.h)
        sym = []
        for own in (0, 1):  # own: occurrences that don't count
            c = np.maximum(self.c - own, 0)
            sym.append(np.where(c > 0, TOP + np.frexp(np.maximum(c, 1).astype(float))[1] - 1, UNSEEN).astype(np.int64))
        at = np.searchsorted(self.h, np.array([h for h, _ in known["top"]], np.uint64))
        for k, (word, _) in enumerate(known["top"]):
            if at[k] < len(self.h) and self.h[at[k]] == word:
                for s in sym:
                    s[at[k]] = k
        self.sym = sym
        total = np.array(known["classes"], float)
        share = lambda own: np.where((sym[own] >= TOP) & (sym[own] < UNSEEN), np.log((c := np.maximum(self.c - own, 1)) / np.maximum(total[np.clip(sym[own] - TOP, 0, 59)], c)), 0.0)
        self.leaf = [share(0), share(1)]
        self.base = np.log10((self.c + 0.1) / (known["n"] + 0.1 * (known["v"] + 1)))
        self.symbols, self.bytes = known["symbol_code"], known["byte_code"]
        self.symbol_bits, self.byte_bits = self.symbols.packed(0), self.bytes.packed(NODE_OF_BYTE)


class Unit:
    """Texts of a unit as arrays over their tokens. more: the last text goes on, so it has no end token yet."""

    def __init__(self, keys: list, texts: pa.Array, more: bool, words: Words) -> None:
        self.held, starts, stops, lens = split(texts)
        self.keys, n = keys, len(keys)
        self.sizes = lens + (1 if not more else np.r_[np.ones(n - 1, int), 0])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(n), self.sizes)
        self.first = self.begins.take(self.text)
        inner = np.arange(len(starts)) + np.repeat(self.begins - (np.cumsum(lens) - lens), lens)
        self.h = np.full(len(self.text), END_HASH)
        self.h[inner] = hashes(self.held, starts, stops)
        self.starts, self.stops = np.zeros(len(self.text), np.int64), np.zeros(len(self.text), np.int64)  # an end token has no bytes
        self.starts[inner], self.stops[inner] = starts, stops
        self.ids = words.places.find(self.h)
        self.trains = ~np.array([held_out(k) for k in keys], bool)[self.text]
        self.sym = np.where(self.trains, words.sym[1].take(self.ids), words.sym[0].take(self.ids))
        self.words = words

    def before(self, values: np.ndarray, k: int, none) -> np.ndarray:
        """The value k tokens before, `none` before the text's begin."""
        out = np.full(len(values), none, values.dtype)
        out[k:] = values[:-k] if len(values) > k else values[:0]
        return np.where(np.arange(len(values)) - k >= self.first, out, none)

    def contexts(self) -> list[np.ndarray]:
        """A number for each context of each token's symbol bits, and the last frequent word before it."""
        one, two = self.before(self.sym, 1, BEGIN), self.before(self.sym, 2, BEGIN)
        index = np.arange(len(self.sym))
        last = self.before(np.maximum.accumulate(np.where(self.sym < TOP, index, -1)), 1, -1)
        last = np.where(last >= self.first, self.sym.take(np.maximum(last, 0)), BEGIN)
        return [one, (1 << 40) + (one << 11) + two, (2 << 40) + (one << 11) + last, last]

    def pairs(self) -> np.ndarray:
        """The pair of two words and the follower, for each token."""
        h = self.h
        mixed = (self.before(h, 2, np.uint64(1)) * M1 + self.before(h, 1, np.uint64(2))) * M2
        mixed = (mixed ^ mixed >> np.uint64(29)) * M3
        return mixed & ~np.uint64(0xFFFF) | h >> np.uint64(48)

    def spelled(self, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The bytes of the words at these tokens, a blank after each, as symbols of the codes; the number in `at` of each,
        and three contexts."""
        sizes = self.stops[at] - self.starts[at] + 1
        owner = np.repeat(np.arange(len(at)), sizes)
        stops = np.cumsum(sizes)
        place = np.arange(len(owner)) - (stops - sizes).take(owner)
        held = self.held.take(np.minimum(self.starts[at].take(owner) + place, len(self.held) - 1)).astype(np.int64) if len(self.held) else np.zeros(len(owner), np.int64)
        held[stops - 1] = 32
        b = [np.where(place >= k, np.r_[np.zeros(min(k, len(held)), np.int64), held[: max(0, len(held) - k)]], 32) for k in (1, 2, 3)]
        two = b[0] | b[1] << 8
        return b[0] << 8 | held, owner, [two + (3 << 40), (two | b[2] << 16) + (4 << 40), (two | last[at].take(owner) << 16) + (5 << 40)]


def slots(context: np.ndarray) -> np.ndarray:
    """Where a context's nodes begin: four times the slot."""
    x = context.astype(np.uint64) * M2
    return ((x ^ x >> np.uint64(31)) * M3 >> np.uint64(64 - SLOT_BITS)).astype(np.int64) * 4


def steps(nodes: np.ndarray) -> np.ndarray:
    """How far from a context's begin its nodes are; the sum is taken modulo MASK + 1."""
    return (nodes.astype(np.uint64) * M1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64) * 4


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(STEPS * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127).astype(np.int8)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, where the words begin and end in them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, upto = lists.values, lists.offsets.to_numpy()
    if not len(flat):
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(len(texts), np.int64)
    edges = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    held = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    real = np.diff(edges) > 0
    before = np.r_[0, np.cumsum(real)]
    return held, edges[:-1][real], edges[1:][real], np.diff(before[upto])


def in_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array, bool, bool]]:
    """Keys and texts of about UNIT bytes; if the first text is the rest of one begun before, and if the last goes on."""
    keys: list = []
    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        begin = 0
        for i in range(len(lens)):
            if size + lens[i] > UNIT and size:
                held.append(batch.column(1).slice(begin, i - begin))
                keys += batch.column(0).slice(begin, i - begin).to_pylist()
                yield keys, pa.concat_arrays(held), False, False
                keys, held, size, begin = [], [], 0, i
            if lens[i] > UNIT:
                text, key, at = batch.column(1)[i].as_py().encode(), batch.column(0)[i].as_py(), 0
                while at < len(text):
                    stop = len(text)
                    if stop - at > UNIT:
                        stop = max(text.rfind(b, at + 1, at + UNIT) for b in (b" ", b"\n", b"\t"))
                        if stop < 0:
                            stops = [x for b in (b" ", b"\n", b"\t") if (x := text.find(b, at + UNIT)) >= 0]
                            stop = min(stops, default=len(text))
                    yield [key], pa.array([text[at:stop].decode()], pa.string()), at > 0, stop < len(text)
                    at = stop
                begin = i + 1
            else:
                size += int(lens[i])
        held.append(batch.column(1).slice(begin))
        keys += batch.column(0).slice(begin).to_pylist()
    if keys:
        yield keys, pa.concat_arrays(held), False, False


@dataclass
class Parts:
    """Files of texts, one a part."""

    spark: SparkSession
    files: list[str]

    @classmethod
    def write(cls, own: DataFrame) -> Parts:
        """Writes (k, t) once; parts are numbered by the task that wrote them, as file names tell."""
        place = f"{shared_dir(own.sparkSession)}/texts-{uuid.uuid4().hex}"
        own.write.option("compression", "zstd").parquet(place)
        store, at = fs.FileSystem.from_uri(place)
        names = [(int(found[1]), x.path) for x in store.get_file_info(fs.FileSelector(at)) if (found := re.search(r"/part-(\d+)-[^/]*\.parquet$", x.path))]
        return cls(own.sparkSession, [f"{place}/{path.rsplit('/', 1)[1]}" for _, path in sorted(names)])

    def each(self, run: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
        """run(part, its batches) of every part, a task each."""
        files = self.files

        def read(file: str) -> Iterator[pa.RecordBatch]:
            store, at = fs.FileSystem.from_uri(file)
            with store.open_input_file(at) as held:
                yield from pq.ParquetFile(held).iter_batches(ROWS, columns=["k", "t"])

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    yield from run(part, read(files[part]))

        return self.spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(every, kind)


def distinct_words(parts: Parts) -> DataFrame:
    """part, kind, h, n. kind 0: each part's words and how often its training texts have them; 1: bytes after bytes."""

    def run(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, some = np.zeros(1 << 16, np.int64), []
        for keys, texts, _, more in in_units(batches):
            held, starts, stops, lens = split(texts)
            trains = ~np.array([held_out(k) for k in keys], bool)
            h, own = hashes(held, starts, stops), np.repeat(trains, lens)
            ends = int(trains.sum()) - bool(more and trains[-1])
            its, n = np.unique(np.r_[h[own], np.full(ends, END_HASH)], return_counts=True)
            others = np.unique(np.r_[h[~own], END_HASH])
            some.append((np.r_[its, others], np.r_[n, np.zeros(len(others), np.int64)]))
            after += np.bincount(held[:-1].astype(np.int64) << 8 | held[1:], minlength=1 << 16)
        if not some:
            return
        h, n = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        full = np.flatnonzero(after)
        for kind, x, y in ((0, h[first].view(np.int64), np.add.reduceat(n, first)), (1, full, after[full])):
            for a in range(0, len(x), 100_000):
                m = len(x[a : a + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, kind, np.int32)), pa.array(x[a : a + m]), pa.array(y[a : a + m])], ["part", "kind", "h", "n"])

    return parts.each(run, "part int, kind int, h long, n long")


def settings(counts: DataFrame | None) -> dict:
    """Totals of the training tokens, the words that are symbols (at most TOP), classes and codes. Few rows each."""
    known = {"n": 0, "v": 0, "top": [], "classes": [0] * 60}
    symbols, after = [0] * SYMBOLS, [[0] * 256 for _ in range(256)]
    if counts is not None:
        once = counts.where("first AND c > 0").select("kind", "h", "c")
        sums = once.where("kind = 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        known["n"], known["v"] = sums["n"], sums["v"]
        frequent = F.col("c") * TOP >= known["n"]
        top = once.where((F.col("kind") == 0) & frequent).orderBy(F.desc("c"), "h").select("h", "c").collect()[:TOP]
        known["top"] = [(np.int64(r["h"]).view(np.uint64), r["c"]) for r in top]
        for r in once.where((F.col("kind") == 0) & ~frequent).groupBy(F.floor(F.log2("c") + 1e-9).alias("k")).agg(F.sum("c").alias("c")).collect():
            known["classes"][r["k"]] = symbols[TOP + r["k"]] = r["c"]
        for r in once.where("kind = 1").select("h", "c").collect():  # at most 65,536
            after[r["h"] >> 8][r["h"] & 255] = r["c"]
    for k, (_, c) in enumerate(known["top"]):
        symbols[k] = c
    symbols[UNSEEN] = known["classes"][0]
    known["symbol_code"], known["byte_code"] = Code([symbols]), Code(after)
    return known


def part_words(place: str, part: int, known: dict) -> Words:
    store, at = fs.FileSystem.from_uri(f"{place}/part={part}")
    rows = pq.read_table(at, filesystem=store, columns=["h", "c"], filters=pc.field("kind") == 0, partitioning=None)
    return Words(rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy(), known)


def count_bits(contexts: list[np.ndarray], symbols: np.ndarray, code: Code, packed: np.ndarray, counts: list[np.ndarray]) -> None:
    """Adds to each table the bits of these symbols in these contexts; equal ones are counted before."""
    for context, out in zip(contexts, counts, strict=True):
        pairs, n = np.unique(context << 16 | symbols, return_counts=True)
        at, owner = code.decisions(pairs & 0xFFFF)
        own = packed.take(at)
        np.add.at(out, ((slots(pairs >> 16).take(owner) + own & MASK) >> 1) + (own >> 48), n.take(owner))


def counted_bits(unit: Unit, counts: list[np.ndarray]) -> None:
    """Adds a unit's training bits to the tables: slot 2i zeros, 2i + 1 ones."""
    *contexts, last = unit.contexts()
    here = np.flatnonzero(unit.trains)
    count_bits([c[here] for c in contexts], unit.sym[here], unit.words.symbols, unit.words.symbol_bits, counts)
    new = here[unit.sym[here] == UNSEEN]
    symbols, _, spelling = unit.spelled(new, last)
    count_bits(spelling, symbols, unit.words.bytes, unit.words.byte_bits, counts)


def followers(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted, distinct pairs with counts: what each tells (0: no candidate; else 1 + 64 if it is the candidate + 8 x the
    level of the candidate's count + that of all others), then the same with one occurrence of the pair itself left out;
    and hits and misses of the latter by the two levels, all occurrences."""
    context = keys >> np.uint64(16)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    total, most = np.add.reduceat(counts, first)[group], np.maximum.reduceat(counts, first)[group]
    index = np.arange(len(keys))
    best = np.minimum.reduceat(np.where(counts == most, index, len(keys)), first)[group]
    hit = best == index
    told = lambda hit, top, rest: np.where(top > 0, 1 + 64 * hit + 8 * (np.searchsorted(LEVELS, top, "right") - 1) + np.searchsorted(LEVELS, rest, "right") - 1, 0).astype(np.uint8)
    whole = told(hit, most, total - most)
    tied = hit & (np.add.reduceat(counts == most, first)[group] > 1)  # another follower is the candidate then
    lower = np.minimum.reduceat(np.where(counts == most - 1, index, len(keys)), first)[group]
    top = np.where(hit & ~tied, most - 1, most)
    rest = np.where(hit & ~tied, total - most, total - most - 1)
    hit = hit & ~tied & (lower > index)
    others = np.where(counts > 0, told(hit, top, np.maximum(rest, 0)), 0).astype(np.uint8)
    seen = others > 0
    cells = np.bincount(others[seen].astype(int) - 1, counts[seen], 128)
    return whole, others, cells


def gathered(parts: Parts, known: dict, words_place: str) -> str:
    """Where parts have what their units' pairs tell; part -1 has the tables, part -2 the cells of followers, part -3 sums of
    the tables of TREE parts each."""
    kind = "kind int, part int, unit int, bucket int, trains boolean, x binary, y binary"
    names = [x.split()[0] for x in kind.split(", ")]
    back = "part int, unit int, bucket int, trains boolean, x binary"
    back_names = [x.split()[0] for x in back.split(", ")]
    buckets = max(1, -(-known["n"] // SHARE))
    width = (2 << SLOT_BITS) // RANGES

    def rows(out: list[tuple], what: list[str]) -> pa.RecordBatch:
        types = {"trains": pa.bool_(), "x": pa.binary(), "y": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(x, types.get(n, pa.int32())) for x, n in zip(zip(*out, strict=True), what, strict=True)], what)

    def run(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        counts = [np.zeros(2 << SLOT_BITS, np.int64) for _ in range(PREDICTORS)]
        for number, (keys, texts, _, more) in enumerate(in_units(batches)):
            words = words or part_words(words_place, part, known)
            unit = Unit(keys, texts, more, words)
            counted_bits(unit, counts)
            pairs, out = unit.pairs(), []
            for trains in (True, False):
                its, n = np.unique(pairs[unit.trains == trains], return_counts=True)
                edges = np.searchsorted((its >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    cell = slice(edges[b], edges[b + 1])
                    out.append((1, part, number, b, trains, squeezed(np.diff(its[cell], prepend=np.uint64(0))), squeezed(n[cell].astype("<u4")) if trains else None))
            if out:
                yield rows(out, names)
        for k, one in enumerate(counts):
            full = np.flatnonzero(one)
            edges = np.searchsorted(full, np.arange(RANGES + 1) * width)
            out = [(0, part, part // TREE, k * RANGES + r, True, squeezed(np.diff(full[edges[r] : edges[r + 1]] - r * width, prepend=0).astype("<u4")), squeezed(one[full[edges[r] : edges[r + 1]]])) for r in np.flatnonzero(np.diff(edges))]
            if out:
                yield rows(out, names)

    def add(held: pa.Table) -> pa.Table:
        bucket = held.column("bucket")[0].as_py()
        x, y = held.column("x").to_pylist(), held.column("y").to_pylist()
        if held.column("kind")[0].as_py() == 0:
            counts = np.zeros(width, np.int64)
            for at, n in zip(x, y, strict=True):
                counts[np.cumsum(restored(at, "<u4"), dtype=np.int64)] += restored(n, "<i8")
            return pa.Table.from_batches([rows([(-3, held.column("unit")[0].as_py(), bucket, True, squeezed(counts.astype("<i8")))], back_names)])
        trains = held.column("trains").to_pylist()
        cells = [np.cumsum(restored(b, "<u8"), dtype=np.uint64) for b in x]
        keys = np.concatenate(cells)
        counts = np.concatenate([restored(n, "<u4").astype(np.int64) if n is not None else np.zeros(len(c), np.int64) for n, c in zip(y, cells, strict=True)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        whole, others, seen = followers(keys, counts)
        out = [(p, u, bucket, t, squeezed((others if t else whole)[np.searchsorted(keys, c)])) for p, u, t, c in zip(held.column("part").to_pylist(), held.column("unit").to_pylist(), trains, cells, strict=True)]
        out.append((-2, 0, bucket, True, squeezed(seen.astype("<i8"))))
        return pa.Table.from_batches([rows(out, back_names)])

    place = f"{shared_dir(parts.spark)}/followers-{uuid.uuid4().hex}"
    def merge(held: pa.Table) -> pa.Table:
        counts = sum((restored(x, "<i8") for x in held.column("x").to_pylist()), np.zeros(width, np.int64))
        return pa.Table.from_batches([rows([(-3, held.column("unit")[0].as_py() // TREE, held.column("bucket")[0].as_py(), True, squeezed(counts.astype("<i8")))], back_names)])

    def finish(held: pa.Table) -> pa.Table:
        counts = sum((restored(x, "<i8") for x in held.column("x").to_pylist()), np.zeros(width, np.int64))
        zeros, ones = counts[::2], counts[1::2]
        made = np.stack([log_odds(zeros, ones), log_odds(np.maximum(zeros - 1, 0), ones), log_odds(zeros, np.maximum(ones - 1, 0))], 1)
        return pa.Table.from_batches([rows([(-1, 0, held.column("bucket")[0].as_py(), True, squeezed(np.pad(made, ((0, 0), (0, 1))).view("<u4").ravel()))], back_names)])

    # a group is a bucket of pairs, or a range of a table over TREE parts
    group = ["kind", "bucket", F.when(F.col("kind") == 0, F.col("unit")).otherwise(0)]
    made = parts.each(run, kind).groupBy(*group).applyInArrow(add, back)
    made.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(place)
    sums = parts.spark.read.schema(back).parquet(place).where("part = -3")
    left = -(-len(parts.files) // TREE)
    while left > TREE:
        sums = written(sums.groupBy("bucket", F.floor(F.col("unit") / TREE)).applyInArrow(merge, back), "tables")
        left = -(-left // TREE)
    sums.groupBy("bucket").applyInArrow(finish, back).write.partitionBy("part").mode("append").parquet(place)
    return place


def read_part(place: str, part: int) -> dict[tuple[int, int, bool], bytes]:
    store, at = fs.FileSystem.from_uri(f"{place}/part={part}")
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return {}
    rows = pq.read_table(at, filesystem=store, partitioning=None)
    return {tuple(r[:3]): r[3] for r in zip(*(rows.column(n).to_pylist() for n in ("unit", "bucket", "trains", "x")), strict=True)}


class Model:
    """Tables of log-odds, the cells of followers, and the gated weights, which go on learning."""

    def __init__(self, tables: list[np.ndarray], cells: np.ndarray) -> None:
        self.tables = tables
        self.cells = log_odds(cells[:64], cells[64:])
        self.weights = np.tile(np.array(START, np.float32), (GATES, 1))
        self.fresh = True

    @classmethod
    def load(cls, place: str) -> Model:
        tables = [np.zeros(4 << SLOT_BITS, np.int8) for _ in range(PREDICTORS)]
        width = (4 << SLOT_BITS) // RANGES
        for (_, bucket, _), x in read_part(place, -1).items():
            k, r = divmod(bucket, RANGES)
            tables[k][r * width : (r + 1) * width] = restored(x, "<u4").view(np.int8)
        cells = sum((restored(x, "<i8") for x in read_part(place, -2).values()), np.zeros(128, np.int64))
        return cls(tables, cells)

    def look_up(self, begins: list[np.ndarray], owner: np.ndarray, packed: np.ndarray, trains: np.ndarray, lift: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Log-odds by predictor, of training texts without the bit itself; gate and bit. begins: slots() of the contexts."""
        bit = (packed >> 48).astype(np.uint8)
        own = (bit + np.uint8(1)) * trains
        odds = [t.take((b.take(owner) + packed & MASK) + own) for t, b in zip(self.tables, begins, strict=True)]
        gate = (packed >> 40).astype(np.uint8) & np.uint8(7) | (odds[1] != 0) * np.uint8(8) | (odds[2] != 0) * np.uint8(16) | np.uint8(lift)
        return odds, gate, bit

    def mix(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        row = gate.astype(np.uint16) << 8
        value = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float32) / STEPS
        z = np.zeros(len(gate), np.float32)
        for k, o in enumerate(odds):
            z += np.outer(self.weights[:, k], value).ravel().take(row | o.view(np.uint8))
        return np.clip(z, -12, 12, out=z)

    def correct(self, odds: list[np.ndarray], gate: np.ndarray, error: np.ndarray, trains: np.ndarray) -> None:
        """One step of each gate's weights against the errors of training bits (bit less probability of a one), by the
        curvature where inputs have the mean square SQUARE."""
        gate, error = gate.astype(np.int64), error * trains
        size = np.abs(error)
        curve = SQUARE * np.bincount(gate, size - size * size, GATES) + 8
        error *= np.float32(1 / STEPS)
        for k, o in enumerate(odds):
            self.weights[:, k] += RATE * np.bincount(gate, error * o, GATES) / curve


def errors(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return bit - 1 / (1 + np.exp(-z))


def refined(z: np.ndarray, bit: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of texts' bits, with a scale and offset that learn as a text goes on, and each bit's error.
    sizes: bits of each text."""
    n = len(sizes)
    begins = np.cumsum(sizes) - sizes
    out, errors = np.zeros(n), np.empty(len(z), np.float32)
    sign = np.float32(1) - 2 * bit.astype(np.float32)  # -1 for a one
    at, span, most = 0, REFINE, int(sizes.max()) if len(z) else 0
    while at < most:
        here = np.flatnonzero(sizes > at)
        lens = np.minimum(sizes[here] - at, span)
        edges = np.cumsum(lens) - lens
        if len(here) == 1:
            own = slice(begins[here[0]] + at, begins[here[0]] + at + lens[0])
        else:
            own = np.repeat(begins[here] + at - edges, lens) + np.arange(int(lens.sum()))
        x, y = z[own], sign[own]
        e = np.exp((np.repeat(state[here, 0], lens) * x + np.repeat(state[here, 1], lens)) * y)  # odds against the bit
        e += 1
        out[here] -= np.add.reduceat(np.log(e), edges)
        errors[own] = error = y / e - y  # e is now 1 + the odds
        state[here, 0] = np.clip(state[here, 0] + RATE_SCALE * np.add.reduceat(error * x, edges) / lens, 0.5, 2)
        state[here, 1] = np.clip(state[here, 1] + RATE_OFFSET * np.add.reduceat(error, edges) / lens, -1, 1)
        at += span
        span = max(REFINE, at // 2)
    return out, errors


def even(n: int) -> list[np.ndarray]:
    """States of n texts before any refinement: followers, symbols, spelling."""
    return [np.tile(np.array([[1.0, 0.0]], np.float32), (n, 1)) for _ in range(3)]


def streams(unit: Unit, a: int, b: int, told: np.ndarray, contexts: list[np.ndarray], model: Model) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The bits of tokens a to b, by kind: log-odds by predictor, gate, bit, whether they train, and how many each text has."""
    words, last = unit.words, contexts[-1]
    low, n = unit.text[a], unit.text[b - 1] - unit.text[a] + 1
    asked = a + np.flatnonzero(told[a:b])
    cell = told[asked].astype(np.int64) - 1
    hit = cell >> 6
    upto = np.r_[0, np.cumsum(hit)]
    text = unit.text[asked]
    index = np.arange(len(asked))
    begin = np.searchsorted(text, text)  # the first question of the text
    since = np.maximum(index - 8, begin)
    right = upto[index] - upto[since]
    recent = log_odds(index - since - right, right)
    before = np.where(index > begin, 1 + np.r_[0, hit[:-1]] if len(hit) else hit, 0)
    yield [model.cells[cell & 63], recent, np.zeros(len(asked), np.int8)], (64 + np.minimum(cell >> 3 & 7, 3) * 3 + before).astype(np.uint8), hit.astype(np.uint8), unit.trains[asked], np.bincount(text - low, minlength=n)
    here = a + np.flatnonzero(~followed(told[a:b]))
    at, owner = words.symbols.decisions(unit.sym[here])
    trains = unit.trains[here].take(owner)
    odds, gate, bit = model.look_up([slots(c[here]) for c in contexts[:3]], owner, words.symbol_bits.take(at), trains, 0)
    yield odds, gate, bit, trains, np.bincount(unit.text[here] - low, words.symbols.sizes[unit.sym[here]], n).astype(np.int64)
    new = here[unit.sym[here] == UNSEEN]
    symbols, whose, spelling = unit.spelled(new, last)
    at, owner = words.bytes.decisions(symbols)
    trains = unit.trains[new].take(whose).take(owner)
    odds, gate, bit = model.look_up([slots(c) for c in spelling], owner, words.byte_bits.take(at), trains, 32)
    yield odds, gate, bit, trains, np.bincount(unit.text[new].take(whose) - low, words.bytes.sizes[symbols], n).astype(np.int64)


def followed(told: np.ndarray) -> np.ndarray:
    """Which tokens are the candidate that their pair tells of."""
    return told > 64


def score_unit(unit: Unit, told: np.ndarray, model: Model, states: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text of a unit. states: of its texts, corrected."""
    out = np.zeros(len(unit.keys))
    contexts = unit.contexts()
    edges = [0]
    for begin, size in zip(unit.begins.tolist(), unit.sizes.tolist(), strict=True):
        if begin + size - edges[-1] > BLOCK:
            edges += [x for x in (begin, *range(begin + BLOCK, begin + size, BLOCK)) if x > edges[-1]]
    for a, b in zip(edges, [*edges[1:], len(unit.ids)], strict=True):
        if a == b:
            continue
        low, n = unit.text[a], unit.text[b - 1] - unit.text[a] + 1
        for state, (odds, gate, bit, trains, sizes) in zip(states, streams(unit, a, b, told, contexts, model), strict=True):
            if model.fresh:
                for _ in range(WARM):
                    model.correct(odds, gate, errors(model.mix(odds, gate), bit), trains)
            made, error = refined(model.mix(odds, gate), bit, sizes, state[low : low + n])
            out[low : low + n] += made
            model.correct(odds, gate, error, trains)
        model.fresh = False
        leaf = np.where(unit.trains[a:b], unit.words.leaf[1].take(unit.ids[a:b]), unit.words.leaf[0].take(unit.ids[a:b]))
        out[low : low + n] += np.bincount(unit.text[a:b] - low, np.where(followed(told[a:b]), 0, leaf), n)
    return out


def told_of(unit: Unit, number: int, held: dict) -> np.ndarray:
    """What the pair of each token tells, from the bytes that came back for the unit's sorted pairs."""
    pairs, out = unit.pairs(), np.zeros(len(unit.ids), np.uint8)
    for trains in (True, False):
        own = unit.trains == trains
        its = np.unique(pairs[own])
        came = [held[k] for k in sorted(k for k in held if k[0] == number and k[2] == trains)]
        values = np.concatenate([restored(x, "u1") for x in came]) if came else np.zeros(0, np.uint8)
        if len(values) != len(its):
            raise ValueError("pairs that the unit has not written: the input was split anew")
        if len(its):
            out[own] = values.take(Places(its).find(pairs[own]))
    return out


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    parts = Parts.write(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")))
    vocabulary = written(distinct_words(parts), "words")
    by = Window.partitionBy("kind", "h")
    counted = vocabulary.withColumns({"c": F.sum("n").over(by), "first": F.min("part").over(by) == F.col("part")})
    words_place = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    counted.repartition("part").write.partitionBy("part").parquet(words_place)
    counts = spark.read.parquet(words_place) if not vocabulary.isEmpty() else None
    known = settings(counts)
    place = gathered(parts, known, words_place)
    kind = "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model = None
        sums = states = None  # of a text that goes on
        for number, (keys, texts, on, more) in enumerate(in_units(batches)):
            if words is None:
                words, model, held = part_words(words_place, part, known), Model.load(place), read_part(place, part)
            unit = Unit(keys, texts, more, words)
            states = states if on else even(len(keys))
            score = score_unit(unit, told_of(unit, number, held), model, states)
            n, per = len(keys), lambda x: np.bincount(unit.text, x, n)  # noqa: B023
            made = np.stack([unit.sizes, per(words.c[unit.ids] > 0), per(words.base[unit.ids]), score, per(unit.stops - unit.starts + 1)])
            sums = made if not on else sums + made
            if more:
                continue
            tokens, seen, base, score, size = sums
            score = score / math.log(10)
            bits = -score * math.log2(10) / np.maximum(size - (tokens > 1), 1)
            columns = [pa.array(keys, pa.int64()), pa.array([held_out(k) for k in keys], pa.bool_()), *(pa.array(np.rint(x).astype(np.int64)) for x in (tokens, seen, np.full(n, known["n"]))), *(pa.array(x, pa.float64()) for x in (base, score, bits))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return parts.each(run, kind).withColumnRenamed("k", key)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
