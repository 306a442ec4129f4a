"""Word shingles of many texts at once, and their TF-IDF weights.

A word is a run of letters, digits and any character beyond ASCII, A-Z in lower
case.  A shingle is ``SHINGLE`` words in a row; a text with fewer words has one
shingle, all of its words; a text without a word has none.  Shingles are 52-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, mix64, utf8

SHINGLE = 5
HASH_BITS = 52
#: Bytes and texts of a block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 4096

_SEED = np.uint64(0x9E3779B97F4A7C15)
_LETTER = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SEED)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_a:_b] = True
_LETTER = _LETTER[_LOWER]
_PLACE = mix64((np.arange(SHINGLE, dtype=np.uint64) + np.uint64(77)) * _SEED) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the text it is in, of texts at ``at`` in ``data``."""
    is_word = _IS_WORD[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = is_word[inner]  # a text's first byte follows nothing
    ends = np.zeros(len(data), bool)
    ends[:-1] = is_word[:-1] & (~is_word[1:] | begins[1:])
    if len(data):
        ends[-1] = is_word[-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    return mix64((total[b] - total[a]) * down[a]), np.searchsorted(at, a, "right") - 1


def shingle_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: first and last + 1 text, and of each text's distinct shingles: text, hash and count, in order."""
    data, offs = utf8(texts)
    for a, b in blocks(offs, BLOCK_BYTES):
        for a2 in range(a, b, BLOCK_TEXTS):
            b2 = min(b, a2 + BLOCK_TEXTS)
            yield a2, b2, *_shingles(data[offs[a2] : offs[b2]], offs[a2 : b2 + 1] - offs[a2])


def _shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, text = word_hashes(data, at)
    n = np.bincount(text, minlength=len(at) - 1)
    keys = []
    top = np.uint64(64 - HASH_BITS)
    if len(word) >= SHINGLE:
        whole = np.flatnonzero(text[SHINGLE - 1 :] == text[: len(text) - SHINGLE + 1])
        h = word[whole] * _PLACE[0]
        for k in range(1, SHINGLE):
            h += word[whole + k] * _PLACE[k]
        keys.append((text[whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (mix64(h) >> top))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        first = np.searchsorted(text, short)
        h = n[short].astype(np.uint64) * _SEED
        for k in range(SHINGLE - 1):
            has = n[short] > k
            h[has] += word[first[has] + k] * _PLACE[k]
        keys.append((short.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix64(h) >> top))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), count


#: How much the inverse document frequency counts: 0 not at all, 1 as it is.  A quarter keeps the copies of a text that a
#: third of all rows hold as similar as those of a rare text.
DAMPING = 0.25


class Weights:
    """Weight of a shingle: its count in the text times its inverse document frequency, scaled and damped.

    With f the share of documents that have it and ``floor`` a share below which
    all shingles count as equally rare, the factor is 1 - damping + damping *
    ln(f) / ln(floor), at most 1.
    """

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, n_docs: int, floor: float, damping: float = DAMPING):
        order = np.argsort(hashes)
        self.hashes = hashes[order].astype(np.uint64)
        f = np.minimum(1.0, docs[order] / max(1, n_docs))
        self.factor = 1 - damping + damping * np.minimum(1.0, np.log(f) / np.log(floor))

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out *= np.where(self.hashes[at] == hashes, self.factor[at], 1.0)
        return out


#: Share of documents below which all shingles count as equally rare.
FLOOR = 1 / 256
#: At least about so many texts are counted together when frequent shingles are looked for.
COUNT_TEXTS = 4096
#: Frequent shingles that are broadcast, 16 bytes each; see :func:`fit_weights`.
MOST_FREQUENT = 1 << 20


def _locally_frequent(floor: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def flush(upto: int) -> pa.RecordBatch:
            got, times = np.unique(np.concatenate([h for _, h in held[:upto]]), return_counts=True)
            keep = times >= floor * sum(rows for rows, _ in held[:upto])
            return pa.record_batch([pa.array(got[keep].astype(np.int64))], names=["h"])

        for batch in batches:
            for a, b, _, h, _ in shingle_blocks(batch.column(0)):
                held.append((b - a, h))
                n += b - a
                if n >= 2 * COUNT_TEXTS:
                    # About half stays, so that the last part is no small one, in which any shingle is frequent.
                    half = len(held) // 2
                    yield flush(half)
                    n -= sum(rows for rows, _ in held[:half])
                    del held[:half]
        if held:
            yield flush(len(held))

    return find


def _count(wanted):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = wanted.value
        total = np.zeros(len(among), np.int64)
        for batch in batches:
            for _, _, _, h, _ in shingle_blocks(batch.column(0)):
                at = np.minimum(np.searchsorted(among, h), len(among) - 1)
                total += np.bincount(at[among[at] == h], minlength=len(among))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(among[some].astype(np.int64)), pa.array(total[some])], names=["h", "n"])

    return count


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, h, _ in shingle_blocks(batch.column(0)):
            yield pa.record_batch([pa.array(h.astype(np.int64))], names=["h"])


def fit_weights(texts: DataFrame, floor: float = FLOOR, damping: float = DAMPING) -> Weights:
    """Document frequencies of all shingles that at least a share ``floor`` of all texts have.

    A shingle that frequent is so in one part of the texts at least, however they
    are parted; so parts propose candidates, and a second pass counts these over
    all texts.  At most (mean shingles of a text) / floor of them exist.  Up to
    ``MOST_FREQUENT`` candidates are broadcast for the count; beyond, all
    shingles are shuffled and counted, and beyond that many frequent ones the
    floor is doubled until they fit.  That depends on the mean length of the
    texts (from 4096 shingles on), not on their number.  ``texts`` has one column.
    """
    spark = texts.sparkSession
    n_docs = texts.count()
    # Small parts of the table are read in one task, without a shuffle.
    parts = max(spark.sparkContext.defaultParallelism, n_docs // (2 * COUNT_TEXTS))
    candidates = texts.coalesce(parts).mapInArrow(_locally_frequent(floor), "h bigint").distinct()
    got = candidates.limit(MOST_FREQUENT + 1).toPandas()["h"].to_numpy(np.int64)
    if not len(got):
        return Weights(np.zeros(0, np.uint64), np.zeros(0), n_docs, floor, damping)
    if len(got) <= MOST_FREQUENT:
        wanted = spark.sparkContext.broadcast(np.sort(got.astype(np.uint64)))
        counts = texts.mapInArrow(_count(wanted), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    else:
        counts = texts.mapInArrow(_all_shingles, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    while True:
        frequent = counts.filter(F.col("n") >= floor * n_docs).limit(MOST_FREQUENT + 1).toPandas()
        if len(frequent) <= MOST_FREQUENT:
            return Weights(frequent["h"].to_numpy(np.int64).astype(np.uint64), frequent["n"].to_numpy(np.float64), n_docs, floor, damping)
        floor *= 2
