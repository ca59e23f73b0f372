"""Packing (op 2): order-preserving dynamic programming over window cuts.

Documents are turned to token ids and laid end to end in the order in which their partition holds them. A sequence is
a window of at most `limit` tokens of that stream. Windows may end where a document or a sentence ends, or, inside a
sentence too long for that, at a fixed distance. The cost of a cut is what the rest of its window is padded with (none
if the length is a power of two) plus a penalty for parting a document; the cheapest cuts are found from left to right,
the best start of each window being the head of a monotone queue over the last `limit` tokens. A partition is worked
through in stretches of STRETCH tokens: windows well before the end of a stretch are settled, the rest goes into the
next one, so memory stays bounded. Partitions are independent; no text is shuffled.

Tokens come from the library, word by word: a text is cut at blanks and between a letter and a following mark or digit
(never inside a special token), a part into runs of letters, digits and other characters where none of the library's
patterns reaches across. Each worker keeps bounded tables of the parts it has seen: when the newer table is full it
becomes the older one, and parts that occur again move from there into the next, so frequent parts stay known. Null and
empty texts consist of the end id alone. Repeated rows and ids are packed as often as they occur.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import table

LIMIT = 4096
END_ID = 2
CUT_SENTENCE, CUT_INSIDE, PER_WINDOW = 24, 256, 16
LEAST_POWER = 256
STRETCH = 1 << 19
SETTLED = 4 * LIMIT
BATCH_BYTES = 1 << 20
#: Bounds of a worker's tables: an executor runs one worker a core beside its JVM.
PARTS_MAX, WORDS_MAX = 100_000, 100_000
RUN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|[_\x1c-\x1f])+")
#: By byte: A-Z as a-z and line ends as blanks; a-z; the second byte of a letter of Latin-1; ASCII marks and digits.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[10] = 32
LETTER, SECOND, MARK = np.zeros((3, 256), bool)
LETTER[97:123] = True
SECOND[128:192] = True
SECOND[[0x97, 0xB7]] = False
MARK[[*range(33, 65), *range(91, 97), *range(123, 127)]] = True


class Encoder:
    """The library's ids of texts, with bounded tables of parts and words."""

    _made: dict[str, Encoder] = {}

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = self.library.get_vocab()
        ends = [i for t, i in vocabulary.items() if re.fullmatch(r".*[.!?]+[\"')\]]*</w>", t)]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[ends] = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}  # the public byte-level alphabet
        self.letters = "".join(letters[b] for b in range(256))
        self.tokenize = self.library.model.tokenize
        self.words: dict[str, list[int]] = {}
        self.renew()
        self.older = self.parts, self.flat, self.bounds

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def renew(self) -> None:
        """New tables of parts; the first number stands for the end id."""
        self.parts: dict[str, int] = {}
        self.flat, self.bounds = array("I", [END_ID]), array("q", [0, 1])

    def letters_only(self, word: str) -> list[int] | None:
        """Ids of a run of letters; None if the library may part it."""
        if word.isascii():
            return [t.id for t in self.tokenize(word.lower())] if word.isalpha() else None
        low = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        if not low.isalpha():  # some letters become a letter and a mark, which the library parts
            return None
        return [t.id for t in self.tokenize(codecs.charmap_decode(low.encode(), "strict", self.letters)[0])]

    def word(self, word: str) -> list[int]:
        """Ids of a run of one kind."""
        if word in self.words:
            return self.words[word]
        ids = self.letters_only(word)
        if ids is None:
            ids = self.library.encode(word, add_special_tokens=False).ids
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def ids(self, part: str) -> list[int]:
        if part.isascii() or unicodedata.is_normalized("NFC", part):
            if part.isalpha() and (ids := self.letters_only(part)) is not None:
                return ids
            if "'" not in part and "<|" not in part and "İ" not in part:  # İ lowers to a letter and a mark, which joins marks behind it
                return [i for w in RUN.findall(part) for i in self.word(w)]
        return self.library.encode(part, add_special_tokens=False).ids

    def learn(self, fresh: list[str]) -> None:
        """Numbers parts that the newer tables lack; their ids come from the older ones if they are there."""
        parts, flat, bounds = self.parts, self.flat, self.bounds
        older, old_flat, old_bounds = self.older
        for part in fresh:
            k = older.get(part)
            flat.extend(self.ids(part.strip(" ")) if k is None else old_flat[old_bounds[k] : old_bounds[k + 1]])
            bounds.append(len(flat))
            parts[part] = len(parts) + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, END_ID after each, and the number of ids of each."""
        if len(self.parts) > PARTS_MAX or len(self.flat) > 16 * PARTS_MAX:
            self.older = self.parts, self.flat, self.bounds
            self.renew()
        if len(self.words) > WORDS_MAX:
            self.words.clear()
        coded, counts = cut(pc.fill_null(texts, ""))
        held = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([x for x in held if x not in self.parts])
        numbers = np.array([self.parts[x] for x in held], np.int64)
        stops = np.cumsum(counts + 1)
        which = np.zeros(int(stops[-1]) if len(stops) else 0, np.int64)
        inner = np.ones(len(which), bool)
        inner[stops - 1] = False
        which[inner] = numbers[coded.indices.to_numpy()]
        starts = np.array(self.bounds, np.int64)
        sizes = np.diff(starts)[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[which] - (ends - sizes)).astype(np.int32), sizes)  # a batch has far less than 2 ** 31 ids
        at += np.arange(total, dtype=np.int32)
        return np.frombuffer(self.flat, np.uint32)[at], np.diff(ends[stops - 1], prepend=0)


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The parts of all texts end to end, each with the blank before it, A-Z lowered, and the number of parts of each text.

    A part begins at every blank and line end, and where an ASCII mark or digit follows a letter of Latin-1: a run of
    letters ends there in the library too. Texts with "<|" are neither lowered nor cut inside words, as the library looks
    for special tokens before it lowers.
    """
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    low = LOWER[data]
    letter = LETTER[low]
    letter[1:] |= (low[:-1] == 0xC3) & SECOND[low[1:]]
    begins = low == 32
    begins[1:] |= letter[:-1] & MARK[low[1:]]
    for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
        own = slice(ends[i - 1] if i else 0, ends[i])
        low[own] = np.where(data[own] == 10, 32, data[own])
        begins[own] = low[own] == 32
    begins = np.append(begins, True)
    begins[ends] = True
    begins[0] = True
    places = np.flatnonzero(begins).astype(np.int32)  # a batch has far less than 2 ** 31 bytes
    parts = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(low))
    return parts.dictionary_encode(), np.diff(np.searchsorted(places, ends), prepend=0)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, rising, and the penalty of each: nothing at a document's end."""
    sentence, document = np.zeros((2, len(ids) + 1), bool)
    sentence[1:] = ends[ids]
    document[doc_ends] = True
    held = sentence | document
    places = np.flatnonzero(held)
    gaps = np.diff(places, prepend=0)
    step = limit // 4
    for p, g in zip(places[gaps > step].tolist(), gaps[gaps > step].tolist(), strict=True):
        held[p - g + step : p : step] = True
    held[(int(places[-1]) if len(places) else 0) + step :: step] = True
    places = np.flatnonzero(held)
    cost = np.where(sentence[places], CUT_SENTENCE, CUT_INSIDE)
    cost[document[places]] = 0
    return places, cost


def choose(places: list[int], cost: list[int], limit: int = LIMIT) -> list[int]:
    """The cheapest cuts among `places` (rising; the last is always one), from 0 on."""
    if not places:
        return []
    place = np.array([0, *places])
    powers = [p for p in (1 << k for k in range(limit.bit_length())) if LEAST_POWER <= p < limit]
    jumps: dict[int, list[int]] = {}  # by end: the starts of windows that are a power of two long
    for p in powers:
        start = np.searchsorted(place, place - p)
        for j in np.flatnonzero((place >= p) & (place[start] == place - p)).tolist():
            jumps.setdefault(j, []).append(int(start[j]))
    where = place.tolist()
    best, back = [0], [-1]
    queue, head = [0], [0]  # a monotone queue of starts, and what orders it: best + place
    first, last, jump = 0, len(where) - 1, jumps.get
    for j in range(1, len(where)):
        here = where[j]
        least = here - limit
        while where[queue[first]] < least:
            first += 1
        i = queue[first]
        value = head[first] + limit - here
        for k in jump(j, ()):
            if best[k] < value:
                value, i = best[k], k
        value += PER_WINDOW
        if j < last:
            value += cost[j - 1]
        best.append(value)
        back.append(i)
        rank = value + here
        while len(head) > first and head[-1] >= rank:
            head.pop()
            queue.pop()
        queue.append(j)
        head.append(rank)
    cuts, j = [], len(where) - 1
    while j > 0:
        cuts.append(where[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """The stream of one partition: holds what is not settled yet."""

    def __init__(self, ends: np.ndarray, limit: int, base: int) -> None:
        self.ends, self.limit, self.next = ends, limit, base
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[list] = []  # key, place of its first id (may lie before the held ids), number of ids

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        start = len(self.ids)
        for key, n in zip(keys, sizes.tolist(), strict=True):
            self.docs.append([key, start, n])
            start += n
        self.ids = np.concatenate([self.ids, ids])

    def settle(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled: all at the end of the partition."""
        if not len(self.ids):
            return []
        doc_ends = np.array([s + n for _, s, n in self.docs], np.int64)
        places, cost = candidates(self.ids, doc_ends[doc_ends > 0], self.ends, self.limit)
        cuts = choose(places.tolist(), cost.tolist(), self.limit)
        if not last:
            cuts = [c for c in cuts if c <= len(self.ids) - SETTLED]
        out, d, begin = [], 0, 0
        for stop in cuts:
            offset = 0
            while begin < stop:
                key, s, n = self.docs[d]
                upto = min(stop, s + n)
                held = self.ids[begin:upto].astype("<u4").tobytes()
                out.append((key, begin - s, upto - begin, zlib.crc32(held), n, self.next, offset))
                offset += upto - begin
                begin = upto
                d += upto == s + n
            self.next += 1
        self.ids = self.ids[begin:].copy()
        self.docs = [[k, s - begin, n] for k, s, n in self.docs[d:]]
        return out


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], pa.int64()) for i in range(7)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(name)
        packer = Packer(encoder.ends, limit, TaskContext.get().partitionId() << 40)
        for batch in batches:
            begin, held = 0, 0
            for i, n in enumerate([*pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), None]):
                if n is None or held and held + n > BATCH_BYTES:
                    part = batch.slice(begin, i - begin)
                    packer.add(part.column(0).to_pylist(), *encoder.encode(part.column(1)))
                    begin, held = i, 0
                    if len(packer.ids) >= STRETCH and (out := packer.settle(False)):
                        yield rows(out)
                held += n or 0
        if out := packer.settle(True):
            yield rows(out)

    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return own.mapInArrow(run, ", ".join(f"{n} long" for n in names)).withColumnRenamed("k", key)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
