"""Byte-level BPE: speculate and verify.

Greedy longest match proposes the tokens of a word.  A sequence of tokens is what
the merges give exactly if every two neighbours are what the merges give for the
two alone, so a vectorised check looks up all neighbours of all new words at once;
pairs not met before are decided once by exact merging and kept.  Only words with
a failing pair are merged exactly; of a long word only the stretches around
failing pairs, widened until they fit with what stands beside them.

Defined results: a null text is empty: no ids; strings of added tokens inside a
text are those tokens, as the library has it by default; ids of documents pass
through, nulls and repeats too; an empty table gives no rows; extra columns are
ignored (:func:`encode_documents`).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, plain, utf8
from .token_counts import ship_tokenizer

#: Words, and pairs of neighbours, that a worker keeps.
CACHE_WORDS, CACHE_PAIRS = 300_000, 2_000_000
#: Bytes of texts that are encoded together; a longer text is by itself.
TEXT_BYTES = 4 << 20
#: A longer word (bytes) is mended in stretches and not kept.
LONG_WORD = 256
#: Bytes from which merging keeps its pairs in a heap.
HEAP_BYTES = 96
_ID_BITS = 24
_ID = (1 << _ID_BITS) - 1
_NEVER = 1 << 62

# The pre-token pattern and the byte alphabet of byte-level BPE vocabularies.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary's strings."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return out | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {as_bytes(s): i for s, i in vocab.items() if s not in self.added}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.added.items()}
        #: The longest token that begins with two given bytes.
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.base = max(self.bytes_of) + 1
        #: Of two neighbours (a * base + b): the merge's rank, then the id that it makes.
        self.rank: dict[int, int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[self.id_of[a] * self.base + self.id_of[b]] = (n << _ID_BITS) | self.id_of[a + b]
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def merged(self, word: bytes) -> list[int]:
        """Exact: the lowest-ranked pair is merged, leftmost first, until none is left."""
        if len(word) >= HEAP_BYTES:
            return self._merged_by_heap(word)
        ids = [self.byte_id[c] for c in word]
        rank, base = self.rank, self.base
        ranks = [rank.get(a * base + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            new = ids[i] = best & _ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] * base + new, _NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(new * base + ids[i + 1], _NEVER)
        return ids

    def _merged_by_heap(self, word: bytes) -> list[int]:
        """The same in n log n: live pairs in a heap by (rank, place), tokens in a linked list; -1 is a token merged away."""
        n, rank, base = len(word), self.rank, self.base
        ids = [self.byte_id[c] for c in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # Out of date: one of the two has changed since.
            if ids[i] < 0 or j >= n or rank.get(ids[i] * base + ids[j]) != r:
                continue
            ids[i], ids[j] = r & _ID, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(ids[i] * base + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] * base + ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while word[i:j] not in id_of:
                j -= 1
            out.append(id_of[word[i:j]])
            i = j
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: proposals, one check of all neighbours, merging where it fails."""
        ids = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(ids)), sizes)
        last = np.ones(len(flat), bool)
        last[:-1] = word_of[1:] != word_of[:-1]
        # A word of one token is checked against itself: neighbour -1.
        after = np.where(last, -1, np.append(flat[1:], -1))
        looked = np.flatnonzero(~last | (sizes[word_of] == 1))
        key = flat[looked] * (self.base + 1) + after[looked] + 1
        kinds, where = np.unique(key, return_inverse=True)
        if len(self.fits) + len(kinds) > CACHE_PAIRS:
            self.fits.clear()
        good = np.fromiter(map(self._fits, kinds.tolist()), bool, len(kinds))[where]
        bad = looked[~good]
        first = np.cumsum(sizes) - sizes
        cut = np.flatnonzero(np.diff(word_of[bad], prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(bad)]):
            w = int(word_of[bad[a]])
            if len(words[w]) <= LONG_WORD:
                ids[w] = self.merged(words[w])
            else:
                ids[w] = self.mended(ids[w], (bad[a:b] - first[w]).tolist())
        return ids

    def mended(self, ids: list[int], bad: list[int]) -> list[int]:
        """The exact ids of a long word from a proposal whose tokens at ``bad`` don't fit with the next ones.

        Left to right, the bytes around such a place are merged anew.  Where the
        result doesn't fit with a token beside it, the stretch grows on that side, to
        twice its tokens each time, so the work is about linear.
        """
        done: list[int] = []
        at = 0  # tokens from here on are not in ``done``
        for p in bad:
            if p + 1 < at:
                continue
            done += ids[at : max(at, p)]
            at = max(at, p)
            left, right = 0, min(len(ids), p + 2) - at
            while True:
                raw = b"".join(map(self.bytes_of.__getitem__, [*done[len(done) - left :], *ids[at : at + right]]))
                new = self.merged(raw)
                stands = len(done) - left
                fits_left = stands == 0 or self._fits(done[stands - 1] * (self.base + 1) + new[0] + 1)
                fits_right = at + right == len(ids) or self._fits(new[-1] * (self.base + 1) + ids[at + right] + 1)
                if fits_left and fits_right:
                    done[stands:] = new
                    at += right
                    break
                grow = max(2, left + right)
                left = left if fits_left else min(len(done), left + grow)
                right = right if fits_right else min(len(ids) - at, right + grow)
        return done + ids[at:]

    def _fits(self, key: int) -> bool:
        got = self.fits.get(key)
        if got is None:
            a, b = divmod(key, self.base + 1)
            pair = [a] if b == 0 else [a, b - 1]
            got = self.fits[key] = self.merged(b"".join(self.bytes_of[i] for i in pair)) == pair
        return got

    def learn(self, words: set[str]) -> None:
        fresh = list(words.difference(self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS and self.known:
            self.known.clear()
            fresh = list(words)
        if fresh:
            for w, ids in zip(fresh, self.encode_words([w.encode() for w in fresh])):
                self.known[w] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))

    def split(self, text: str) -> list[str]:
        if self.parts is None or not self.parts.search(text):
            return self.words.findall(text)
        out = []
        for i, part in enumerate(self.parts.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def documents(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Of each text: number of ids, ids joined by commas, and the bytes that the ids decode to."""
        split = [self.split(t) for t in texts]
        words = {w for s in split for w in s}.difference(self.added)
        self.learn(words)
        for s, i in self.added.items():
            self.known[s] = (1, str(i), self.bytes_of[i])
        out = []
        for s in split:
            got = list(map(self.known.__getitem__, s))
            out.append((sum(x[0] for x in got), ",".join([x[1] for x in got]), b"".join([x[2] for x in got])))
        for w in words:
            if len(w) > LONG_WORD:
                del self.known[w]
        return out


_coders: dict[int, Coder] = {}


def _encoder(shipped: Broadcast, full: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shipped.value)
        if key not in _coders:
            _coders[key] = Coder(shipped.value)
        coder = _coders[key]
        for batch in batches:
            texts = plain(batch.column(1))
            for a, b in blocks(utf8(texts)[1], TEXT_BYTES):
                rows = coder.documents([t or "" for t in texts.slice(a, b - a).to_pylist()])
                columns = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(r[2].decode("utf-8", "replace").encode()).hexdigest() for r in rows], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    flat = [np.fromstring(r[1], np.int32, sep=",") for r in rows]
                    ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))), pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *columns], names=names)

    return encode


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids and decoded."""
    spark = docs.sparkSession
    shipped = ship_tokenizer(spark, tokenizer_path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return docs.select(id_col, text_col).mapInArrow(_encoder(shipped, full), schema).withColumnRenamed("id", id_col)
