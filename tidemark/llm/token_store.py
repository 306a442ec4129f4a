"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a range of documents, in order of id.  Its ids are cut
into blocks; a block stores its minimum, its values less the minimum at a width
that a percentile of them fits in, and an exception list of the positions and
full values of the rest.  A footer has the start of each block and the id and
length of each document.  A new file begins after ``FILE_IDS`` ids; a document may
go on in the next one.  Files are written through Spark's text sink (one row a
group of blocks, a newline after each), so by its committer and on any file system.

Documents are range-partitioned and sorted by id before they are encoded: texts
cross the network once, ids never.

Encoding: no token of the tokenizer spans white space, so a text's ids are those
of its words; each worker encodes a word once with the library and keeps it, up
to ``CACHE_WORDS``.

Defined results: a null text is empty (its only id is the end id); null ids come
first, ids are whole numbers of 64 bits; documents with the same id stand side by side in order of text; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gc
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import blocks, materialise, plain, scratch_path, tasks, utf8
from .token_counts import load_tokenizer, ship_tokenizer

MAGIC = b"TMIDPFOR"
BLOCK = 4096
#: Share of a block's values that fit its width; the rest are exceptions.
PERCENTILE = 95.0
#: Blocks that are gathered before they are written.
GROUP = 64
#: Groups of blocks in a file: 64 MB or so.
FILE_GROUPS = 128
FILE_IDS, FILE_ROWS = FILE_GROUPS * GROUP * BLOCK, FILE_GROUPS + 2
#: What a footer has of each document, or of the part of it that the file holds: id, whether it is null, its number in
#: the partition, ids in all, of them in files before, and in this one.
PIECE = {"id": "<i8", "null": "<u1", "number": "<u8", "total": "<u8", "skip": "<u8", "n": "<u8"}
#: Bytes of texts that are encoded together; a longer text is by itself.
TEXT_BYTES = 4 << 20
#: Words and ids that a worker keeps.
CACHE_WORDS, CACHE_IDS = 400_000, 8_000_000
#: Suffix of the tokens that end a word.
WORD_END = "</w>"
#: Words that the library encodes in one call.
CALL_WORDS = 2000
#: A letter never merges with these, and none of them alone begins a contraction.
STOPS = b".,;:!?"
#: Letters below this have been the same since Unicode 5; each but U+0130 is one letter in lower case too.
PLAIN_END = "\u0250"


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    k = int(np.ceil(PERCENTILE / 100 * (len(rest) - 1)))
    width = int(np.partition(rest, k)[k]).bit_length()
    over = np.flatnonzero(rest >> width) if width < 32 else np.zeros(0, np.int64)
    small = rest & np.uint32((1 << width) - 1)
    if width == 16:
        bits = small.astype("<u2").tobytes()
    else:
        bits = np.packbits(((small[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()
    return struct.pack("<IIBI", len(ids), low, width, len(over)) + bits + over.astype("<u4").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    n, low, width, n_over = struct.unpack_from("<IIBI", data, at)
    at += 13
    size = (n * width + 7) // 8
    if width == 16:
        rest = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        rest = bits.astype(np.float32) @ (2.0 ** np.arange(width, dtype=np.float32)) if width <= 24 else (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1)
        rest = rest.astype(np.uint32)
    else:
        rest = np.zeros(n, np.uint32)
    at += size
    over = np.frombuffer(data, "<u4", n_over, at)
    rest[over] = np.frombuffer(data, "<u4", n_over, at + 4 * n_over)
    return rest + np.uint32(low)


def _letters(word: bytes) -> bool:
    return word.isalpha() or (not word.isascii() and word.decode().isalpha())


def plain_letters(word: bytes) -> bool:
    """Whether a word is one run of letters, also after the tokenizer has composed it and made it lower case."""
    if word.isalpha() or word.isascii():
        return word.isalpha()
    shown = unicodedata.normalize("NFC", word.decode())
    return shown.isalpha() and max(shown) < PLAIN_END and "\u0130" not in shown


def crc_joined(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings in a row from those of both; the second has ``n`` bytes.

    CRCs are polynomials, lowest power in the top bit: the first is multiplied by x to the power of 8 n.
    """

    def times(p: int, q: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if p >> bit & 1:
                out ^= q
            q = q >> 1 ^ (0xEDB88320 if q & 1 else 0)
        return out

    power, base = 1 << 31, 1 << 23
    while n:
        if n & 1:
            power = times(power, base)
        base, n = times(base, base), n >> 1
    return times(power, a) ^ b


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(len(self.held), len(values)), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordEncoder:
    """Ids of texts through a bounded cache of words, each encoded by the library.

    Words are bytes between ASCII blanks, with A-Z in lower case, which the
    tokenizer does itself; texts that may hold an added token's string keep their
    case.  A word of plain letters and a full stop or the like is the letters' ids
    and the stop's; of any other word with a stop the library decides.
    """

    def __init__(self, tok):
        self.tok = tok
        vocab = tok.get_vocab()
        last = [i for t, i in vocab.items() if t.endswith(WORD_END)]
        self.ends_word = np.isin(np.arange(max(vocab.values()) + 1), last) if last else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.begin, self.size = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def _ask(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: the library encodes many with blanks between and tells where each id stands."""
        out: list[list[int]] = []
        for i in range(0, len(words), CALL_WORDS):
            shown = [w.decode() for w in words[i : i + CALL_WORDS]]
            got = self.tok.encode(" ".join(shown), add_special_tokens=False)
            sizes = np.fromiter(map(len, shown), np.int64, len(shown))
            at = np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids))
            cut = np.searchsorted(at, np.cumsum(sizes + 1) - sizes - 1).tolist()
            ids = got.ids
            out += [ids[a:b] for a, b in zip(cut, [*cut[1:], len(ids)])]
        return out

    def _ask_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of words of letters, and each word's number: a word's last id is one that ends words.

        Every word ends at least one pre-token, and every pre-token has one id that
        ends words; so None, if some word isn't one pre-token (lower case may add a mark).
        """
        calls = [b" ".join(words[i : i + CALL_WORDS]).decode() for i in range(0, len(words), CALL_WORDS)]
        got = self.tok.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got]) if got else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return None
        return ids, np.diff(ends, prepend=0)

    def learn(self, words: list[bytes]) -> None:
        # Without ids that end words, nothing is known of what stands beside a stop.
        ended = [w for w in words if w[-1] in STOPS and plain_letters(w[:-1])] if self.ends_word is not None else []
        need = set(words).difference(ended).union(w[:-1] for w in ended).union(w[-1:] for w in ended).difference(self.index)
        letters = [w for w in need if _letters(w)] if self.ends_word is not None else []
        got = self._ask_letters(letters) if letters else None
        if got is None:
            letters = []
        else:
            self._add(letters, *got)
        rest = list(need.difference(letters))
        ids = self._ask(rest)
        self._add(rest, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        if ended:
            core = np.fromiter((self.index[w[:-1]] for w in ended), np.int64, len(ended))
            stop = np.fromiter((self.index[w[-1:]] for w in ended), np.int64, len(ended))
            both = np.stack([core, stop], 1).ravel()
            self._add(ended, self._gather(both), self.size.held[core] + self.size.held[stop])

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers, one after the other."""
        sizes = self.size.held[at]
        ends = np.cumsum(sizes)
        return self.flat.held[np.repeat(self.begin.held[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(words, range(self.size.n, self.size.n + len(words))))
        self.begin.add(self.flat.n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.flat.add(ids)

    def encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in UTF-8, and the number of each text's."""
        split = [(t if b"<|" in t else t.lower()).split() for t in raw]
        words = list(chain.from_iterable(split))
        fresh = list(set(words).difference(self.index))
        if fresh:
            if self.index and (len(self.index) + len(fresh) > CACHE_WORDS or self.flat.n > CACHE_IDS):
                self.clear()
                fresh = list(set(words))
            self.learn(fresh)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        ids, ends = self._gather(at), np.cumsum(self.size.held[at])
        of_text = np.fromiter(map(len, split), np.int64, len(split))
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(of_text)])])


#: Of a worker process, which serves many tasks.
_encoders: dict[int, WordEncoder] = {}


class Files:
    """Ids of a partition as rows of its files.

    Each full file is FILE_ROWS rows: the magic bytes, full groups of blocks, and the footer; so the sink, which
    begins a file after as many rows, begins one where this does.  A document may go on in the next file.
    """

    def __init__(self, part: int):
        self.part, self.number, self.docs = part, 0, 0
        self.begin()

    def begin(self) -> None:
        self.n, self.at = 0, len(MAGIC) + 1
        self.starts: list[int] = []
        self.open: list[np.ndarray] = []
        self.held = 0
        self.pieces: list[tuple[np.ndarray, ...]] = []

    def group(self, ids: np.ndarray) -> bytes:
        out = bytearray()
        for i in range(0, len(ids), BLOCK):
            self.starts.append(self.at + len(out))
            out += pack_block(ids[i : i + BLOCK])
        self.at += len(out) + 1
        return bytes(out)

    def add(self, keys: np.ndarray, null: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """Documents with their ids, one at least each, and the rows that are complete by then."""
        ends = np.cumsum(sizes)
        begins, lo = ends - sizes, 0
        numbers = self.docs + np.arange(len(sizes))
        self.docs += len(sizes)
        while lo < len(ids):
            hi = min(len(ids), lo + FILE_IDS - self.n)
            if not self.n:
                yield MAGIC
            some = slice(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(begins, hi, "left")))
            skip = np.maximum(lo - begins[some], 0)
            self.pieces.append((keys[some], null[some], numbers[some], sizes[some], skip, np.minimum(ends[some], hi) - begins[some] - skip))
            for a in range(lo, hi, GROUP * BLOCK):
                part = ids[a : min(hi, a + GROUP * BLOCK)]
                self.open.append(part)
                self.held += len(part)
                if self.held >= GROUP * BLOCK:
                    every = np.concatenate(self.open)
                    yield self.group(every[: GROUP * BLOCK])
                    self.open, self.held = [every[GROUP * BLOCK :]], len(every) - GROUP * BLOCK
            self.n += hi - lo
            lo = hi
            if self.n == FILE_IDS:
                yield from self.close()

    def close(self) -> Iterator[bytes]:
        """The last rows of the open file."""
        if self.n:
            if self.held:
                yield self.group(np.concatenate(self.open))
            columns = [np.concatenate(x) for x in zip(*self.pieces)]
            foot = struct.pack("<IIQQ", self.part, self.number, len(self.starts), len(columns[0])) + np.array(self.starts, "<u8").tobytes()
            foot += b"".join(c.astype(k).tobytes() for c, k in zip(columns, PIECE.values()))
            yield foot + struct.pack("<Q", self.at) + MAGIC
            self.number += 1
        self.begin()


def _writer(shipped: Broadcast, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shipped.value)
        if key not in _encoders:
            _encoders[key] = WordEncoder(load_tokenizer(shipped))
        coder, files = _encoders[key], Files(TaskContext.get().partitionId())
        rows = lambda parts: [pa.record_batch([pa.array([b], pa.binary())], names=["value"]) for b in parts]
        # Lists of millions of words hold no cycles; looking for some takes an eighth of the time.
        gc.disable()
        try:
            for batch in batches:
                texts, ids = plain(batch.column(1)), plain(batch.column(0))
                keys, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for a, b in blocks(utf8(texts)[1], TEXT_BYTES):
                    raw = texts.slice(a, b - a).cast(pa.binary()).to_pylist()
                    got, sizes = coder.encode([t or b"" for t in raw])
                    yield from rows(files.add(keys[a:b], null[a:b], np.insert(got, np.cumsum(sizes), end_id), sizes + 1))
            yield from rows(files.close())
        finally:
            gc.enable()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    shipped = ship_tokenizer(spark, tokenizer_path)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # A splitter is an id and a hash: a repeated id is cut over partitions too.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = slim.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order, "text")
    rows = ranged.mapInArrow(_writer(shipped, end_id), "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_ROWS).text(path)


def read_file(data: memoryview) -> tuple[int, int, dict[str, np.ndarray], Iterator[np.ndarray]]:
    """Part, number of the file in it, the columns of PIECE, and the ids of the documents one by one."""
    if bytes(data[: len(MAGIC)]) != MAGIC or bytes(data[-len(MAGIC) - 1 : -1]) != MAGIC:
        raise ValueError("not a token file")
    (foot,) = struct.unpack_from("<Q", data, len(data) - len(MAGIC) - 9)
    part, number, n_blocks, n_docs = struct.unpack_from("<IIQQ", data, foot)
    at = foot + 24
    starts = np.frombuffer(data, "<u8", n_blocks, at)
    at += 8 * n_blocks
    pieces = {}
    for name, kind in PIECE.items():
        pieces[name] = np.frombuffer(data, kind, n_docs, at).astype(np.int64)
        at += n_docs * np.dtype(kind).itemsize

    def documents() -> Iterator[np.ndarray]:
        k, rest = 0, np.zeros(0, np.uint32)
        for n in pieces["n"]:
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(unpack_block(data, int(starts[k])))
                have += len(parts[-1])
                k += 1
            every = np.concatenate(parts) if len(parts) > 1 else rest
            yield every[:n]
            rest = every[n:]

    return part, number, pieces, documents()


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            part, number, p, every = read_file(memoryview(content.as_buffer()))
            crcs = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in every], np.int64)
            whole = np.full(len(crcs), part, np.int64), np.full(len(crcs), number, np.int64)
            columns = [*whole, p["number"], p["total"], p["skip"], p["n"], np.cumsum(p["n"]) - p["n"], crcs]
            yield pa.record_batch([pa.array(p["id"], pa.int64(), mask=p["null"] > 0), *map(pa.array, columns)], names=["id", "part", "file", "number", "total", "skip", "n", "inside", "crc"])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, number, pieces) to (part, number, crc): pieces are (skip, n, crc) in order, one a file."""
    for batch in batches:
        crcs = []
        for pieces in batch.column(2).to_pylist():
            crc = 0
            for p in pieces:
                crc = crc_joined(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield pa.record_batch([*batch.columns[:2], pa.array(crcs, pa.int64())], names=["part", "number", "joined"])


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per stored document: id, start, n_tokens, ids_crc32, all from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    kinds = "id bigint, part bigint, file bigint, number bigint, total bigint, skip bigint, n bigint, inside bigint, crc bigint"
    rows = materialise(files.mapInArrow(_reader, kinds), "token-index")
    # One row for each file.
    sums = rows.groupBy(F.col("part").alias("p"), F.col("file").alias("f")).agg(F.sum("n").alias("m"))
    before = sums.select("p", "f", (F.sum("m").over(Window.orderBy("p", "f")) - F.col("m")).alias("before"))
    # Only documents that go on in another file have several pieces.
    cut = rows.filter("n < total").groupBy("part", "number").agg(F.array_sort(F.collect_list(F.struct("skip", "n", "crc"))).alias("pieces"))
    joined = cut.mapInArrow(_join_pieces, "part bigint, number bigint, joined bigint")
    out = rows.filter("skip = 0").join(F.broadcast(before), (F.col("part") == F.col("p")) & (F.col("file") == F.col("f"))).join(joined, ["part", "number"], "left")
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), F.col("total").alias("n_tokens"), F.coalesce("joined", "crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_index(docs.sparkSession, path, id_col)
