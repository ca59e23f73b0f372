"""Token counts (op 6): lengths only, from Arrow batches balanced by bytes.

A text is cut where one blank stands between two other characters. No piece of the vocabulary has a word-start mark
after its first character, so no merge crosses such a blank and the counts of the parts add up to the library's count
of the whole. Parts repeat, so each worker keeps a bounded table of counts it has seen. A text that holds the
word-start mark itself is encoded whole.

Null and empty texts have 0 bytes and 0 tokens. Ties, repeated rows and extra columns have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import table

MARK = "▁"
BLANK = re.compile(r"(?<=[^ ]) (?=[^ ])")
BATCH_BYTES = 4 << 20
SEEN_MAX = 1_000_000
_open: dict[str, tuple] = {}


def _library(name: str):
    """The tokenizer's count function and the table of counts, one of each in a worker."""
    if name not in _open:
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in made.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            count = lambda texts: [len(x.ids) for x in made.encode_batch(texts, add_special_tokens=False)]
        _open[name] = (count, {})
    return _open[name]


def parts(text: str) -> list[str]:
    """The text cut at every safe blank."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return BLANK.split(text)
    return text.split(" ")


def lengths(texts: Iterable[str | None], name: str) -> list[int]:
    """Token counts of a bounded batch of texts."""
    count, seen = _library(name)
    pieces = name.endswith(".model")
    out, waiting, missing = [], [], {}
    for i, text in enumerate(texts):
        out.append(0)
        if not text:
            continue
        if not pieces or MARK in text:
            out[i] = count([text])[0]
            continue
        found = list(map(seen.get, own := parts(text)))
        if None in found:
            waiting.append((i, own))
            missing.update((x, 0) for x, n in zip(own, found, strict=True) if n is None)
        else:
            out[i] = sum(found)
    if missing:
        fresh = list(missing)
        missing = dict(zip(fresh, count(fresh), strict=True))
        for i, own in waiting:
            out[i] = sum(missing[x] if x in missing else seen[x] for x in own)
        if len(seen) + len(missing) > SEEN_MAX:
            seen.clear()
        if len(missing) <= SEEN_MAX:
            seen.update(x for x in missing.items() if len(x[0]) <= 64)
    return out


def balanced(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text stands alone."""
    begin, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def count_tokens(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in balanced(batch.column(1)):
                rows = batch.slice(a, b - a)
                n = pa.array(lengths(rows.column(1).to_pylist(), name), pa.int64())
                size = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), size, n, pc.greater(n, limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return own.mapInArrow(run, "k long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
