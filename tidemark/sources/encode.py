"""Encoders of a query's bounded result: JSON with anchors, and framed chunks."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import MS, SEC


def anchor(first: Column) -> Column:
    return F.floor(first / SEC).cast("long")


def with_offsets(df: DataFrame, ts: str = "ts_ns", series: str = "series") -> DataFrame:
    """Adds ts_anchor (seconds of the series' first event), ts_ms and ts_off_ns; sum of the three is ``ts``."""
    firsts = df.groupBy(F.col(series).alias("_s")).agg(F.min(ts).alias("_first"))
    out = df.join(firsts, F.col(series).eqNullSafe(F.col("_s"))).withColumn("ts_anchor", F.expr(f"_first div {SEC}"))
    out = out.withColumn("_rest", F.col(ts) - F.col("ts_anchor") * SEC)
    return out.withColumn("ts_ms", F.expr(f"_rest div {MS}")).withColumn("ts_off_ns", F.col("_rest") % MS).drop("_s", "_first", "_rest")


def events_json(rows: Iterable[tuple[int, object]], range_final: bool = False, timed_out: bool = False) -> str:
    """One JSON document of ordered (ts_ns, value) rows; keys sorted, flags only if true."""
    rows = list(rows)
    base = rows[0][0] // SEC if rows else 0
    rest = [t - base * SEC for t, _ in rows]
    doc: dict = {"tsAnchor": base, "tsMs": [r // MS for r in rest], "tsNs": [r % MS for r in rest], "values": [v for _, v in rows]}
    doc |= {k: True for k, on in (("rangeFinal", range_final), ("timedOut", timed_out)) if on}
    return json.dumps(doc, sort_keys=True)


def bins_json(rows: Iterable[dict], range_final: bool = False) -> str:
    """One JSON document of ordered bins with ts1, ts2, cnt, min, max, avg."""
    rows = list(rows)
    base = rows[0]["ts1"] // SEC if rows else 0
    off = lambda k: [r[k] - base * SEC for r in rows]
    doc: dict = {"tsAnchor": base, "counts": [r["cnt"] for r in rows], "mins": [r["min"] for r in rows], "maxs": [r["max"] for r in rows], "avgs": [r["avg"] for r in rows]}
    for k in ("ts1", "ts2"):
        doc |= {f"{k}Ms": [x // MS for x in off(k)], f"{k}Ns": [x % MS for x in off(k)]}
    if range_final:
        doc["rangeFinal"] = True
    return json.dumps(doc, sort_keys=True)


def json_frames(bodies: Iterable[str]) -> Iterator[bytes]:
    """Length in 15 columns, newline, body, newline."""
    for body in bodies:
        data = body.encode()
        yield f"{len(data):15}\n".encode() + data + b"\n"


def binary_frames(bodies: Iterable[bytes]) -> Iterator[bytes]:
    """Length as 32-bit little-endian, 12 zero bytes, body, zeros up to a multiple of 8."""
    for body in bodies:
        yield struct.pack("<I12x", len(body)) + body + b"\0" * (-len(body) % 8)


def cbor(value: object) -> bytes:
    """RFC 8949 form of maps, lists, texts, whole numbers, doubles, booleans and null."""
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, int):
        return _cbor_head(0, value) if value >= 0 else _cbor_head(1, -1 - value)
    if isinstance(value, str):
        return _cbor_head(3, len(value.encode())) + value.encode()
    if isinstance(value, dict):
        return _cbor_head(5, len(value)) + b"".join(cbor(x) for pair in value.items() for x in pair)
    items = list(value)  # type: ignore[call-overload]
    return _cbor_head(4, len(items)) + b"".join(map(cbor, items))


def _cbor_head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    width = next(w for w in range(4) if n < 1 << (8 << w))
    return bytes([major << 5 | 24 + width]) + n.to_bytes(1 << width, "big")


def events_cbor(rows: Iterable[tuple[int, object]], scalar_type: str, range_final: bool = False) -> bytes:
    """One document of ordered (ts_ns, value) rows."""
    rows = list(rows)
    doc: dict = {"tss": [t for t, _ in rows], "values": [v for _, v in rows], "scalar_type": scalar_type}
    return cbor(doc | ({"rangeFinal": True} if range_final else {}))


def bins_cbor(rows: Iterable[dict], range_final: bool = False) -> bytes:
    """One document of ordered bins with ts1, ts2, cnt, min, max, avg."""
    rows = list(rows)
    names = {"ts1s": "ts1", "ts2s": "ts2", "counts": "cnt", "mins": "min", "maxs": "max", "avgs": "avg"}
    return cbor({k: [r[c] for r in rows] for k, c in names.items()} | ({"rangeFinal": True} if range_final else {}))


def _unsigned(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def download_frame(ts: str, pulse: str, payload: str) -> Column:
    """An event of the binary download: length and 1, time, pulse, payload, length again; all big-endian."""
    length = _unsigned(F.octet_length(payload) + 17, 4)
    return F.concat(length, F.unhex(F.lit("01")), _unsigned(F.col(ts), 8), _unsigned(F.col(pulse), 8), F.col(payload).cast("binary"), length)


def download_header(header: dict) -> bytes:
    """The frame that precedes a channel's events: length and 0, JSON, length again."""
    body = json.dumps(header, separators=(",", ":")).encode()
    length = struct.pack(">I", len(body) + 1)
    return length + b"\0" + body + length
