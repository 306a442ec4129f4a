"""Framed CBOR documents of events, as they are posted or downloaded: {"tss": [...], "values": [...]}."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "path string, ts_ns bigint, value double, text string"


def from_cbor(data: bytes, at: int = 0) -> tuple[object, int]:
    """The item at ``at`` and where the next one begins; definite lengths only."""
    major, short = data[at] >> 5, data[at] & 31
    size = 1 << (short - 24) if 24 <= short < 28 else 0
    if short > 27 or at + 1 + size > len(data):
        raise ValueError(f"unsupported or truncated CBOR at byte {at}")
    raw, at = data[at + 1 : at + 1 + size], at + 1 + size
    n = int.from_bytes(raw, "big") if size else short
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        body = data[at : at + n]
        if len(body) < n:
            raise ValueError(f"truncated CBOR at byte {at}")
        return (body.decode() if major == 3 else body), at + n
    if major in (4, 5):
        items = []
        for _ in range(n * (major - 3)):
            item, at = from_cbor(data, at)
            items.append(item)
        return (items if major == 4 else dict(zip(items[::2], items[1::2]))), at
    if major == 6:
        return from_cbor(data, at)
    if size >= 2:
        return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], raw)[0], at
    return {20: False, 21: True, 22: None, 23: None}[n], at


def bodies(data: bytes) -> Iterator[bytes]:
    """Bodies of frames: 32-bit little-endian length, 12 bytes, body, zeros up to a multiple of 8."""
    at = 0
    while at < len(data):
        if at + 16 > len(data):
            raise ValueError(f"truncated frame at byte {at}")
        (n,) = struct.unpack_from("<I", data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"truncated frame at byte {at}")
        yield data[at + 16 : at + 16 + n]
        at += 16 + n + -n % 8


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "ts_ns", "value", "text"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for body in bodies(content):
                doc, _ = from_cbor(body)
                times, values = doc.get("tss", []), doc.get("values", [])
                if len(times) != len(values):
                    raise ValueError(f"{path}: {len(times)} times, {len(values)} values")
                numbers = [None if v is None or isinstance(v, str) else float(v) for v in values]
                texts = [v if isinstance(v, str) else None for v in values]
                yield pa.record_batch([pa.array([path] * len(times), pa.string()), pa.array(times, pa.int64()), pa.array(numbers, pa.float64()), pa.array(texts, pa.string())], names=names)


def read_frames(spark: SparkSession, root: str, streaming: bool = False) -> DataFrame:
    """(path, ts_ns, value, text) of all files of frames below ``root``, or of those that arrive there.

    Numbers and booleans are in ``value``, strings in ``text``.
    """
    if streaming:
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        found = spark.readStream.format("binaryFile").schema(schema).load(root)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(F.col("path"), F.col("content")).mapInArrow(_parse, EVENTS)
