"""Token counts with overlap resynchronisation.

Documents up to ``chunk_chars`` characters are encoded whole.  Longer ones are
encoded as overlapping chunks with offsets.  Two neighbours are spliced at a
place that is proven stable: one over which no pre-token of the supported
tokenizers reaches whatever stands around it, and between two of which both
chunks have the same tokens at the same places.  Such are a single blank between
two characters that are not white space, and a change between letters, digits
and other characters, unless an apostrophe (contractions), a mark (composition)
or U+0130 (two characters in lower case) stands there.  Where an overlap has no
such places, or the tokens there differ, the overlap is doubled; when that has
failed ``WIDENINGS`` times, the chunk is encoded anew from its first token that is
not settled yet and to twice its length, so that a text without stable places
costs a few times its length.

Defined results: a null text is empty and has no tokens; ids are passed through,
nulls and repeats too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, plain, utf8

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Bytes of texts that go to the library in one call; a longer text is by itself.
CALL_BYTES = 1 << 20
#: Times that an overlap is doubled.
WIDENINGS = 2

_LETTER, _DIGIT, _OTHER = r"[\p{L}--\u0130]", r"\p{N}", r"[\S--[\p{L}\p{N}\p{M}'\u0130]]"
_CHANGES = [(_LETTER, _DIGIT), (_DIGIT, _LETTER), (_LETTER, _OTHER), (_OTHER, _LETTER), (_DIGIT, _OTHER), (_OTHER, _DIGIT)]
_STABLE = regex.compile(r"(?V1)(?<=\S)(?=[ \n]\S)|" + "|".join(f"(?<={a})(?={b})" for a, b in _CHANGES))
_loaded: dict[int, object] = {}


def ship_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file as a broadcast: a few MB whatever the data, and no path that executors must have."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def load_tokenizer(shipped: Broadcast):
    """The library's tokenizer, built once in each worker process, one thread a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(shipped.value)
    if key not in _loaded:
        tok = Tokenizer.from_str(shipped.value)
        tok.no_truncation()
        tok.no_padding()
        _loaded[key] = tok
    return _loaded[key]


class Piece:
    """A chunk's tokens: ids and their absolute character spans."""

    def __init__(self, start: int, encoding):
        self.start = start
        self.ids = np.array(encoding.ids, np.int64)
        self.spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(self.ids)).reshape(-1, 2) + start

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        at = (self.spans[:, 0] >= a) & (self.spans[:, 1] <= b)
        return self.ids[at], self.spans[at]

    def cuts(self, p: int) -> bool:
        """Whether no token reaches over character p."""
        return not bool(np.any((self.spans[:, 0] < p) & (self.spans[:, 1] > p)))


def splice_point(text: str, left: Piece, right: Piece, end: int, margin: int = 0) -> int | None:
    """A proven common boundary within the overlap [right.start, end), or None.

    ``margin``: characters that an added token may have, so that one which begins
    before the overlap ends before the boundary.
    """
    stable = [m.start() for m in _STABLE.finditer(text, right.start + 1, end)]
    if len(stable) < 2 or stable[-1] < right.start + margin:
        return None
    a, b = stable[0], stable[-1]
    if not all(piece.cuts(p) for piece in (left, right) for p in (a, b)):
        return None
    (ids, spans), (ids2, spans2) = left.between(a, b), right.between(a, b)
    return b if len(ids) and np.array_equal(ids, ids2) and np.array_equal(spans, spans2) else None


def encode_long(text: str, encode: Callable[[str], object], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, margin: int = 0) -> np.ndarray:
    """The ids of a whole text, from overlapping chunks."""
    done: list[np.ndarray] = []
    left, end = Piece(0, encode(text[:chunk])), min(chunk, len(text))
    since = 0  # tokens of ``left`` from this character on are not in ``done``
    while end < len(text):
        width, new_end, at = min(overlap, chunk // 2), min(len(text), end + chunk), None
        for _ in range(WIDENINGS + 1):
            start = end - width
            if start <= since:
                break
            right = Piece(start, encode(text[start:new_end]))
            at = splice_point(text, left, right, end, margin)
            if at is not None:
                break
            width *= 2
        if at is not None:
            done.append(left.between(since, at)[0])
            left, end, since = right, new_end, at
        else:  # this chunk replaces its predecessor
            end = min(len(text), end + max(chunk, end - since))
            left = Piece(since, encode(text[since:end]))
    done.append(left.ids[left.spans[:, 0] >= since] if since else left.ids)
    return np.concatenate(done)


def _counter(shipped: Broadcast, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(shipped)
        margin = max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)
        for batch in batches:
            column = plain(batch.column(1))
            offsets = utf8(column)[1]
            n = np.zeros(len(column), np.int64)
            for a, b in blocks(offsets, CALL_BYTES):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                for i, e in zip(short, tok.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
                    n[a + i] = len(e)
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        n[a + i] = len(encode_long(t, lambda x: tok.encode(x, add_special_tokens=False), chunk, overlap, margin))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    shipped = ship_tokenizer(spark, tokenizer_path)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(_counter(shipped, chunk_chars, overlap_chars), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
