"""Archived data files: one directory per channel and time bin, events in a binary layout.

    .../<channel>/<number of the time bin>/<split>/<width of the bin in ms>_00000_Data

beside each an index file with ``_Index`` appended.  Files are found and read by
Spark's binaryFile source, one task for many of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import MS

# Fixed values of the layout: digits of the path's parts, flags and numbers of types, longest events by dimensions.
PATH = r"([^/]+)/(\d{19})/(\d{10})/(\d{19})_00000_Data"
COMPRESSED, BIG_ENDIAN, SHAPED = 0x80, 0x20, 0x10
TYPES = {0: "?", 1: "?", 2: "i1", 3: "u1", 4: "i2", 5: "u2", 7: "i4", 8: "u4", 9: "i8", 10: "u8", 11: "f4", 12: "f8", 13: "S"}
LONGEST = {0: 64 << 10, 1: 32 << 20, 2: 200 << 20}

HEAD = struct.Struct(">iqqqqbbiBB")  # length, ttl, time, pulse, time of the source, status, severity, optional, flags, type
EVENTS = "channel string, bin_ns bigint, path string, ts_ns bigint, pulse bigint, dtype int, payload binary, values array<double>, discard string"


def files(spark: SparkSession, root: str, index: bool = False) -> DataFrame:
    """(channel, bin_ns, width_ns, split, path, length, content) of all data or index files below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_Data_Index" if index else "*_Data").load(root)
    part = lambda i: F.regexp_extract("path", PATH, i)
    width = part(4).cast("long") * MS
    return found.filter(F.col("path").rlike(PATH)).select(part(1).alias("channel"), (part(2).cast("long") * width).alias("bin_ns"), width.alias("width_ns"), part(3).cast("int").alias("split"), "path", "length", "content")


def index_entries(index_files: DataFrame) -> DataFrame:
    """(channel, bin_ns, split, path, ts_ns, position) of index files: 2 bytes, then pairs of 64-bit big-endian numbers."""
    number = lambda at: f"CAST(conv(hex(substring(content, {at}, 8)), 16, 10) AS BIGINT)"
    entries = f"transform(sequence(0, CAST((length - 2) div 16 AS INT) - 1), i -> struct({number('3 + 16 * i')} AS ts_ns, {number('11 + 16 * i')} AS position))"
    whole = "CASE WHEN length < 2 OR (length - 2) % 16 <> 0 THEN raise_error(concat('bad index file ', path)) WHEN length > 2 THEN " + entries + " END"
    held = index_files.select("channel", "bin_ns", "split", F.regexp_replace("path", "_Index$", "").alias("path"), F.expr(whole).alias("e"))
    return held.select("channel", "bin_ns", "split", "path", F.explode("e").alias("e")).select("channel", "bin_ns", "split", "path", "e.*")


def first_entry(entries: DataFrame, beg: int, end: int, expand: bool = False) -> DataFrame:
    """Of each file the first entry at or after ``beg``, if it is before ``end`` or ``expand`` is set."""
    first = entries.filter(F.col("ts_ns") >= beg).groupBy("path").agg(F.min(F.struct("ts_ns", "position")).alias("e")).select("path", "e.*")
    return first if expand else first.filter(F.col("ts_ns") < end)


def last_entry_before(entries: DataFrame, beg: int) -> DataFrame:
    return entries.filter(F.col("ts_ns") < beg).groupBy("path").agg(F.max(F.struct("ts_ns", "position")).alias("e")).select("path", "e.*")


def files_for_range(data_files: DataFrame, entries: DataFrame, beg: int, end: int) -> DataFrame:
    """Files with the events of [beg, end) and, of each channel and split, the last bin that holds an earlier event."""
    earlier = entries.filter((F.col("ts_ns") < beg) & (F.col("bin_ns") <= beg)).groupBy("channel", "split").agg(F.max("bin_ns").alias("_from"))
    keyed = data_files.filter(F.col("bin_ns") < end).join(earlier, ["channel", "split"], "left")
    return keyed.filter(F.coalesce(F.col("bin_ns") >= F.col("_from"), F.col("bin_ns") + F.col("width_ns") > beg)).drop("_from")


def unshuffle_bits(data: bytes, size: int) -> bytes:
    """Elements of ``size`` bytes from their bit planes; a multiple of 8 elements."""
    planes = np.frombuffer(data, np.uint8).reshape(size * 8, -1)
    bits = np.unpackbits(planes, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes()


def decompress(data: bytes, size: int) -> bytes:
    """Blocks of bit planes, each compressed with LZ4; the elements beyond a multiple of 8 are stored as they are."""
    total, block = struct.unpack_from(">QI", data)
    codec, at, out = pa.Codec("lz4_raw"), 12, []
    left = total // size // 8 * 8 * size
    block = block // size // 8 * 8 * size
    if left and not block:
        raise ValueError("no block size")
    while left:
        (n,) = struct.unpack_from(">I", data, at)
        take = min(block, left)
        out.append(unshuffle_bits(codec.decompress(data[at + 4 : at + 4 + n], take, asbytes=True), size))
        at, left = at + 4 + n, left - take
    return b"".join(out) + data[at : at + total - sum(map(len, out))]


def _fault(path: str, at: int, what: str) -> ValueError:
    return ValueError(f"{path} at byte {at}: {what}")


def _events(path: str, data: bytes, dims: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Time, pulse, type, flags and payload of a file's events; one that is still being written ends it."""
    if len(data) < 6:
        return
    version, size = struct.unpack_from(">hi", data)
    if version != 0 or not 8 <= size < 512 or len(data) < size + 2 or struct.unpack_from(">i", data, size - 2)[0] != size:
        raise _fault(path, 0, "bad header")
    at = size + 2
    while at + HEAD.size <= len(data):
        n, _, ts, pulse, _, _, _, optional, flags, dtype = HEAD.unpack_from(data, at)
        if not HEAD.size + 4 <= n <= LONGEST[dims] or optional != -1 or dtype not in TYPES:
            raise _fault(path, at, f"bad event: length {n}, optional part {optional}, type {dtype}")
        if at + n > len(data):
            return
        body = at + HEAD.size
        if flags & COMPRESSED:
            if data[body] != 0:
                raise _fault(path, at, "unknown compression")
            body += 1
        if flags & SHAPED:
            body += 1 + 4 * data[body]
        if struct.unpack_from(">i", data, at + n - 4)[0] != n:
            raise _fault(path, at, "lengths differ")
        payload = data[body : at + n - 4]
        if flags & COMPRESSED:
            payload = decompress(payload, max(1, np.dtype(TYPES[dtype]).itemsize))
        yield ts, pulse, dtype, flags, payload
        at += n


def read_events(data_files: DataFrame, dtype: int, shape: tuple[int, ...] = (), beg: int | None = None, end: int | None = None) -> DataFrame:
    """The events of files, in file order, with their numbers (64-bit integers beyond 2**53 are rounded; strings: null).

    ``discard`` is null, or why the event doesn't count: "unordered" (earlier than
    one before it in the file), "range" (at or after ``end``), "type" or "shape"
    (other than asked for).  Events before ``beg`` stay: the last is the one before.
    """
    size = int(np.prod(shape)) if shape else 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for channel, bin_ns, path, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows: list[tuple] = []
                held, latest = 0, None
                for ts, pulse, kind, flags, payload in _events(path, content, len(shape)):
                    numbers = None
                    if TYPES[kind] != "S":
                        typed = np.dtype(TYPES[kind]).newbyteorder(">" if flags & BIG_ENDIAN else "<")
                        numbers = np.frombuffer(payload[: len(payload) // typed.itemsize * typed.itemsize], typed).astype(np.float64)
                    why = "unordered" if latest is not None and ts < latest else "range" if end is not None and ts >= end else "type" if TYPES[kind] != TYPES[dtype] else "shape" if numbers is not None and len(numbers) != size else None
                    latest = ts
                    rows.append((channel, bin_ns, path, ts, pulse, kind, payload, numbers, why))
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return data_files.select("channel", "bin_ns", "path", "content").mapInArrow(parse, EVENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.string()]
    names = [part.split()[0] for part in EVENTS.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
