"""Suffix-array deduplication (op 7): bytes covered by a string of LENGTH bytes that starts elsewhere too.

1. Every start of a string of LENGTH bytes is given to an anchor: of the GRAM-byte hashes within the string, the least
   one, the leftmost of equals. Equal strings have their anchors at the same distance and with the same hash. A run of
   starts with one anchor, with the bytes its strings cover, is a piece. Anchors whose hash occurs once in the corpus
   have no repeated string.
2. Pieces with equal bytes become one with a number. An anchor hash with a single such piece is settled: all its
   starts are repeated or none is. The others' bytes are fetched and meet by anchor hash.
3. There the collection's Burrows-Wheeler transform and longest common prefixes are built column by column: each piece
   is read as eight strings of 8-byte symbols, one per remainder of the start, and each round puts one symbol in front
   of every string, inserts the new suffixes where the transform's ranks say, and takes their common prefixes from
   the least value between a symbol's neighbouring occurrences. Transform, prefixes and owners are files that each
   round reads from front to end and writes anew. A start is repeated if its suffix has LENGTH bytes in common with a
   neighbour, or if its piece has copies.
4. Repeated starts go back to all documents with that piece; the union of their strings is removed.

Passages of many short words may be shorter than LENGTH bytes. They lose nothing, but are counted: of every PASSAGE + 1
runs of PASSAGE words in a row the one with the least 64-bit hash is an anchor, the leftmost of equals, and passage_words are the words that
anchors cover whose hash other anchors have too. So any 2 * PASSAGE words that stand elsewhere too count at least PASSAGE.

Null texts are empty. Texts under LENGTH bytes lose nothing. Repeated rows are documents that repeat each other. A
document is known by its id and a hash of its text. Texts are joined with what is found in them by a shuffle at every
size.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.common import cut, table, written

LENGTH = 400
GRAM = 200
PASSAGE = 25
SYMBOL = 8
BATCH_BYTES = 1 << 20
SEGMENT = 4 << 20
MEETING = 1000
NO_ID = -(1 << 63)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash value per byte, and powers of the base and of its inverse modulo 2**64, n of each at least."""
    held = _tables.get(which)
    if held is None or len(held[1]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        values = np.random.default_rng(7 + which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        rows = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            rows.append(np.multiply.accumulate(p))
        held = _tables[which] = (values, *rows)
    return held


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def pieces(held: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each piece its text, first start in it, number of starts, distance of the anchor, its hash, two hashes of its bytes."""
    n = len(held)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    sums = []
    for which in (0, 1):
        values, powers, _ = _powers(which, n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(values[held] * powers[:n], out=s[1:])
        sums.append(s)
    of = lambda which, a, b: (sums[which][b] - sums[which][a]) * _powers(which, n + 1)[2][a]
    grams = n - gram + 1
    h = mixed((sums[0][gram:] - sums[0][:grams]) * _powers(0, n + 1)[2][:grams])
    low = np.uint64((1 << int(n).bit_length()) - 1)
    order = (h & ~low) | np.arange(grams, dtype=np.uint64)
    span = length - gram + 1
    padded = np.full(-(-grams // span) * span, ~np.uint64(0), np.uint64)
    padded[:grams] = order
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    starts = n - length + 1
    anchor = (np.minimum(left[:starts], right[span - 1 : span - 1 + starts]) & low).astype(np.int64)
    stops = np.cumsum(sizes)
    first = np.flatnonzero(np.repeat(stops, sizes)[:starts] >= np.arange(starts) + length)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    a = anchor[first]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(a) != 0)]))
    begin, end = first[new], first[np.append(new[1:], len(first)) - 1]
    a = a[new]
    text = np.searchsorted(stops, begin, side="right")
    c = [mixed(of(w, begin, end + length) + (a - begin).astype(np.uint64) * np.uint64(BASES[1 - w])) for w in (0, 1)]
    return text, begin - (stops - sizes)[text], end - begin + 1, a - begin, h[a].view(np.int64), c[0].view(np.int64), c[1].view(np.int64)


class Columns:
    """The files of one collection: read from front to end each round and then written anew, in place."""

    def __init__(self, folder: str, rows: int, kind: type) -> None:
        kinds = {"bwt": kind, "lcp": np.uint8, "who": np.int64}
        self.files = [np.memmap(os.path.join(folder, f"{uuid.uuid4().hex}.{n}"), k, "w+", shape=(rows,)) for n, k in kinds.items()]
        self.rows = 0

    def put(self, *columns: np.ndarray) -> None:
        self.rows = len(columns[0])
        for file, held in zip(self.files, columns, strict=True):
            file[: self.rows] = held

    def get(self) -> list[np.ndarray]:
        return [file[: self.rows] for file in self.files]


def least_between(table_: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value in [a, b] for each pair, by a table of minima over powers of two."""
    k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table_[0].dtype)
    for level in np.unique(k):
        here = k == level
        row = table_[level]
        out[here] = np.minimum(row[a[here]], row[b[here] - (1 << int(level)) + 1])
    return out


def transform(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise construction over strings symbols[begin : begin + size]: (string << 8 | suffix length) of every suffix in order, and common prefixes with the one before (at most 255)."""
    n = len(begins)
    top = int(symbols.max()) + 1 if len(symbols) else 1
    kind = np.uint16 if top < 65_535 else np.int32
    ends = begins + sizes
    before = lambda i, j: np.where(sizes[i] > j, symbols[np.maximum(ends[i] - j - 1, 0)], top).astype(kind)
    everyone = np.arange(n)
    files = Columns(folder, n + int(sizes.sum()), kind)
    files.put(before(everyone, 0), np.zeros(n, np.uint8), everyone << 8)
    rows = everyone.copy()
    for j in range(1, int(sizes.max()) + 1):
        bwt, lcp, who = files.get()
        going = np.flatnonzero(sizes >= j)
        r = rows[going]
        order = np.argsort(bwt, kind="stable")
        place = np.empty(len(bwt), np.int64)
        place[order] = np.arange(len(bwt))
        at = place[r]
        levels = [lcp]
        while len(levels[-1]) > (half := 1 << (len(levels) - 1)):
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        c = bwt[r]
        left, right = order[np.maximum(at - 1, 0)], order[np.minimum(at + 1, len(order) - 1)]
        has_left, has_right = (at > 0) & (bwt[left] == c), (at + 1 < len(order)) & (bwt[right] == c)
        new = n + at
        size = len(bwt) + len(going)
        old = np.ones(size, bool)
        old[new] = False
        out = [np.empty(size, x.dtype) for x in (bwt, lcp, who)]
        for x, held in zip(out, (bwt, lcp, who), strict=True):
            x[old] = held
        out[0][new] = before(going, j)
        out[2][new] = going << 8 | min(j, 255)
        common = np.zeros(len(r), np.int64)
        common[has_left] = least_between(levels, left[has_left] + 1, r[has_left]).astype(np.int64) + 1
        out[1][new] = np.minimum(common, 255)
        after = least_between(levels, r[has_right] + 1, right[has_right]).astype(np.int64) + 1
        out[1][new[has_right] + 1] = np.minimum(after, 255)
        rows[going] = new
        files.put(*out)
    _, lcp, who = files.get()
    return np.array(who), np.array(lcp)


def repeated_starts(texts: list[bytes], leads: list[int], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece a mark per start: whether its string starts at another place too. texts are distinct; equal
    strings lie at the same distance from the anchor, which is leads[i] bytes into texts[i]."""
    words = length // SYMBOL
    front = -np.array(leads, np.int64) % SYMBOL  # bytes before each piece, so that its anchor begins a symbol
    lens = np.array([len(t) for t in texts], np.int64) + front
    room = (lens + 2 * SYMBOL - 1) // SYMBOL * SYMBOL
    base = np.cumsum(room) - room
    held = np.zeros(int(room.sum()) + SYMBOL, np.uint8)
    for b, t in zip((base + front).tolist(), texts, strict=True):
        held[b : b + len(t)] = np.frombuffer(t, np.uint8)
    marks = [np.full(len(t) - length + 1, m > 1) for t, m in zip(texts, copies, strict=True)]
    with tempfile.TemporaryDirectory() as folder:
        for rest in range(SYMBOL):
            view = np.frombuffer(held.tobytes(), ">u8", count=(len(held) - rest) // SYMBOL, offset=rest)
            late = front > rest  # the first symbol would hold bytes before the piece
            sizes = (lens - rest) // SYMBOL - late
            own = np.flatnonzero(sizes >= words)
            if not len(own):
                continue
            begins = base[own] // SYMBOL + late[own]
            index = np.repeat(begins - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))
            codes = np.zeros(len(view), np.int64)
            codes[index] = np.unique(view[index], return_inverse=True)[1]
            who, lcp = transform(codes, begins, sizes[own], folder)
            same = lcp >= words
            hit = same | np.append(same[1:], False)
            for x in who[hit].tolist():
                i = int(own[x >> 8])
                marks[i][int(lens[i] - rest) // SYMBOL * SYMBOL + rest - (x & 255) * SYMBOL - int(front[i])] = True
    return marks


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the true stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


DOC = ["id", "h"]
ROW = "id long, h long, s array<long>, n long, lead long, fp long, c1 long, c2 long"


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(t).alias("h"), t.cast("binary").alias("t"))


def cut_to_pieces(own: DataFrame, length: int, gram: int, segment: int) -> DataFrame:
    """ROW for every piece of the documents (id, h, t) with all the starts at which the document has it."""

    def grouped(text: np.ndarray, s: np.ndarray, *rest: np.ndarray) -> tuple:
        order = np.lexsort((s, rest[4], rest[3], text))
        text, s, rest = text[order], s[order], [x[order] for x in rest]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (rest[3][1:] != rest[3][:-1]) | (rest[4][1:] != rest[4][:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(s)), pa.int32()), pa.array(s))
        return text[new], lists, *[x[new] for x in rest]

    def cut_long(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        """Row, place and bytes of parts of `segment` starts; every string lies in the part that has its start."""
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py()
            for a in range(0, max(1, len(text) - length + 1), segment):
                yield i, a, text[a : a + segment + length - 1]

    def found_in(batch: pa.RecordBatch, parts: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(b"".join(t for _, _, t in parts), np.uint8)
        found = list(pieces(flat, np.array([len(t) for _, _, t in parts], np.int64), length, gram))
        if len(found[0]):
            part = found[0]
            found[0], found[1] = np.array([i for i, _, _ in parts])[part], found[1] + np.array([a for _, a, _ in parts])[part]
            rows, lists, *rest = grouped(*found)
            ids, hs = (np.array(batch.column(k).to_pylist(), np.int64)[rows] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hs), lists, *map(pa.array, rest)], [x.split()[0] for x in ROW.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for part in cut_long(batch):
                parts.append(part)
                held += len(part[2])
                if held >= BATCH_BYTES:
                    yield from found_in(batch, parts)
                    parts, held = [], 0
            if parts:
                yield from found_in(batch, parts)

    return own.select("id", "h", "t").mapInArrow(run, ROW)


def fetch(own: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """fp, c1, c2, m, lead, t: the bytes of wanted pieces (id, h, s, n, lead, fp, c1, c2, m)."""
    lists = written(wanted.groupBy(*DOC).agg(F.collect_list(F.struct("s", "n", "lead", "fp", "c1", "c2", "m")).alias("x")), "wanted")
    cutting = lambda x: F.struct(x["fp"].alias("fp"), x["c1"].alias("c1"), x["c2"].alias("c2"), x["m"].alias("m"), x["lead"].alias("lead"), F.substring("t", (x["s"] + 1).cast("int"), (x["n"] + length - 1).cast("int")).alias("t"))
    once = own.select(*DOC, "t").join(lists, DOC)
    return once.select(F.explode(F.transform("x", cutting)).alias("y")).select("y.*")


def meet(texts: DataFrame, length: int, tasks: int) -> DataFrame:
    """c1, c2, runs: repeated starts of the pieces (fp, c1, c2, m, lead, t), which meet by fp."""

    def settle(rows: list[dict]) -> pa.RecordBatch:
        rows = list({(x["c1"], x["c2"]): x for x in rows}.values())
        found = [runs_of(x) for x in repeated_starts([x["t"] for x in rows], [x["lead"] for x in rows], [x["m"] for x in rows], length)]
        held = [[{"a": a, "b": b} for a, b in x] for x in found]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([x["c1"] for x in rows], pa.int64()), pa.array([x["c2"] for x in rows], pa.int64()), pa.array(held, kind)], ["c1", "c2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if len(rows) >= MEETING and rows[-1]["fp"] != x["fp"]:
                    yield settle(rows)
                    rows = []
                rows.append(x)
        if rows:
            yield settle(rows)

    return texts.repartition(tasks, "fp").sortWithinPartitions("fp").mapInArrow(run, "c1 long, c2 long, runs array<struct<a:long,b:long>>")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """id, h, x: for documents that lose bytes, the starts [a, b) of repeated strings."""
    own = keyed(docs, key, text)
    by = Window.partitionBy("fp")
    rows = cut_to_pieces(own.where(F.octet_length("t") >= length), length, gram, segment)
    rows = rows.withColumns({"all": F.sum(F.size("s")).over(by), "one": (F.min("c1").over(by) == F.max("c1").over(by)) & (F.min("c2").over(by) == F.max("c2").over(by))})
    live = written(rows.where("all > 1").drop("all"), "pieces")
    classes = live.where("not one").groupBy("fp", "c1", "c2", "n", "lead").agg(F.sum(F.size("s")).alias("m"), F.min(F.struct("id", "h", F.get("s", F.lit(0)).alias("s"))).alias("at"))
    texts = fetch(own, classes.select("at.*", "n", "lead", "fp", "c1", "c2", "m"), length)
    tasks = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(meet(texts, length, 2 * tasks).where(F.size("runs") > 0), "repeats")
    some = live.where("not one").join(found, ["c1", "c2"]).select(*DOC, "s", F.explode("runs").alias("r")).select(*DOC, "r", F.explode("s").alias("s")).select(*DOC, (F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b")).alias("b"))
    whole = live.where("one").select(*DOC, "n", F.explode("s").alias("s")).select(*DOC, F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))
    return written(some.unionByName(whole).groupBy(*DOC).agg(F.collect_set(F.struct("a", "b")).alias("x")), "removals")


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    held = np.frombuffer(text, np.uint8)
    real = np.ones(len(held) + 2, bool)
    real[0] = real[-1] = False
    real[1:-1] = ~((held == 32) | (held >= 9) & (held <= 13))
    edges = np.flatnonzero(real[1:] != real[:-1])
    a, b = edges[::2], edges[1::2]
    values, powers, inverse = _powers(0, len(held) + 1)
    sums = np.zeros(len(held) + 1, np.uint64)
    np.cumsum(values[held] * powers[: len(held)], out=sums[1:])
    return mixed((sums[b] - sums[a]) * inverse[a])


def passage_anchors(words: np.ndarray, texts: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors begin in the words of several texts (numbers in `texts`, rising), and their hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, powers, inverse = _powers(1, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    h = mixed((sums[size:] - sums[:n]) * inverse[:n])
    inside = texts[size - 1 :] == texts[:n]
    keys = np.where(inside, h >> np.uint64(1), ~np.uint64(0))  # a run over two texts is the least of no window
    span = size + 1
    padded = np.full(n + span, ~np.uint64(0), np.uint64)
    padded[:n] = keys
    # a text with fewer runs than a window has one window
    begins = np.searchsorted(texts, texts[:n])
    ends = np.searchsorted(texts, texts[:n], side="right") - size + 1  # runs of the text end here
    first = (np.arange(n) + span <= ends) | (np.arange(n) == begins)
    at = np.flatnonzero(first & inside)
    windows = np.lib.stride_tricks.sliding_window_view(padded, span)
    least = np.concatenate([np.argmin(windows[at[k : k + 65_536]], axis=1) for k in range(0, len(at), 65_536)]) if len(at) else np.zeros(0, np.int64)
    chosen = np.unique(np.where(at + least < ends[at], at + least, at))  # a single run's window reaches into the next text
    return chosen, h[chosen].view(np.int64)


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = PASSAGE) -> DataFrame:
    """id, h, passage_words: for documents with repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held = 0, 0
            for i in range(batch.num_rows + 1):
                n = len(batch.column(2)[i].as_buffer() or b"") if i < batch.num_rows else 0
                if i == batch.num_rows or held and held + n > BATCH_BYTES:
                    words = [word_hashes(x) for x in batch.column(2).slice(begin, i - begin).to_pylist()]
                    sizes = np.array([len(x) for x in words], np.int64)
                    at, fp = passage_anchors(np.concatenate(words), np.repeat(np.arange(begin, i), sizes), size) if len(words) else (np.zeros(0, np.int64),) * 2
                    if len(at):
                        row = np.repeat(np.arange(begin, i), sizes)[at]
                        place = at - (np.cumsum(sizes) - sizes)[row - begin]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place), pa.array(fp)], ["id", "h", "place", "fp"])
                    begin, held = i, 0
                held += n

    anchors = keyed(docs, key, text).select("id", "h", "t").mapInArrow(run, "id long, h long, place long, fp long")
    anchors = written(anchors, "anchors")
    repeated = cut(anchors.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))  # so that Spark can split a hot hash below
    found = anchors.join(repeated, "fp", "left_semi").groupBy(*DOC).agg(F.sort_array(F.collect_set("place")).alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct((p + size).alias("upto"), (s["n"] + F.least(F.lit(size), p + size - s["upto"])).alias("n")), lambda s: s["n"])
    return found.select(*DOC, covered.alias("passage_words"))


def spans(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """The bytes that the strings at these starts cover, as maximal [from, to)."""
    out: list[list[int]] = []
    for x in sorted((x["a"], x["b"] + length - 1) for x in starts):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def dedup_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per row of docs: the key, n_bytes, n_removed, n_spans, kept_sha256, passage_words, and kept (the remaining bytes)."""
    kind = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, kept binary"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for x in batch.slice(i, 500).to_pylist():
                    gone = spans(x["x"] or [], length)
                    kept = without(x["t"], gone)
                    rows.append((x["key"], len(x["t"]), len(x["t"]) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), x["passage_words"] or 0, kept))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    gone = removals(docs, length, gram, key, text, segment).join(passages(docs, key, text), DOC, "full")
    out = keyed(docs, key, text).join(gone, DOC, "left").select(F.col("key").cast("long").alias("key"), "t", "x", "passage_words")
    return out.mapInArrow(run, kind).withColumnRenamed("k", key)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents")).drop("kept")
