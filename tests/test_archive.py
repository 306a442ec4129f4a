import struct

import numpy as np
import pyarrow as pa
import pytest

from tidemark.plans.grid import MS
from tidemark.sources import archive, encode, frames


def event(ts, payload, dtype=7, flags=archive.BIG_ENDIAN, dims=b"", compressed=b""):
    body = struct.pack(">qqqqbbiBB", 0, ts, ts // MS, ts, 0, 0, -1, flags, dtype) + compressed + dims + payload
    n = struct.pack(">i", len(body) + 8)
    return n + body + n


def data_file(events, name=b"CH"):
    n = struct.pack(">i", len(name) + 8)
    return struct.pack(">h", 0) + n + name + n + b"".join(events)


def shuffled(values):
    """The stored form of 32-bit numbers: bit planes of blocks of 16, LZ4, rest as it is."""
    raw = np.asarray(values, ">i4").tobytes()
    out = struct.pack(">QI", len(raw), 64)
    whole = len(values) // 8 * 8 * 4
    for a in range(0, whole, 64):
        part = np.frombuffer(raw[a : min(a + 64, whole)], np.uint8).reshape(-1, 4)
        planes = np.packbits(np.unpackbits(part, axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes()
        packed = pa.Codec("lz4_raw").compress(planes, asbytes=True)
        out += struct.pack(">I", len(packed)) + packed
    return out + raw[whole:]


def put(root, channel, number, content, times):
    folder = root / channel / f"{number:019}" / "0000000000"
    folder.mkdir(parents=True)
    path = folder / f"{1000:019}_00000_Data"
    path.write_bytes(content)
    path.with_name(path.name + "_Index").write_bytes(b"\0\0" + b"".join(struct.pack(">qq", t, i) for i, t in enumerate(times)))


INT = struct.Struct(">i").pack


def test_scalars_range_and_one_before(spark, tmp_path):
    for number, times in ((1, (1000, 1500)), (2, ()), (3, (3100, 3200, 3150, 3900)), (5, (5000,))):
        put(tmp_path, "CH", number, data_file([event(t * MS, INT(t)) for t in times]), [t * MS for t in times])
    entries = archive.index_entries(archive.files(spark, str(tmp_path), index=True))
    assert entries.count() == 7
    beg, end = 3000 * MS, 3800 * MS
    chosen = archive.files_for_range(archive.files(spark, str(tmp_path)), entries, beg, end)
    assert sorted(r.bin_ns // (1000 * MS) for r in chosen.select("bin_ns").collect()) == [1, 2, 3]
    got = archive.read_events(chosen, 7, (), beg, end).orderBy("bin_ns", "pulse").collect()
    assert [(r.ts_ns // MS, r["values"], r.discard) for r in got] == [
        (1000, [1000.0], None), (1500, [1500.0], None), (3100, [3100.0], None),
        (3150, [3150.0], "unordered"), (3200, [3200.0], None), (3900, [3900.0], "range"),
    ]
    first = archive.first_entry(entries, 3000 * MS, 3100 * MS)
    assert first.count() == 0 and archive.first_entry(entries, 3000 * MS, 3100 * MS, expand=True).count() == 2
    assert {r.ts_ns // MS for r in archive.last_entry_before(entries, beg).collect()} == {1500}


def test_no_earlier_event(spark, tmp_path):
    put(tmp_path, "CH", 3, data_file([event(3100 * MS, INT(1))]), [3100 * MS])
    entries = archive.index_entries(archive.files(spark, str(tmp_path), index=True))
    assert archive.files_for_range(archive.files(spark, str(tmp_path)), entries, 3000 * MS, 4000 * MS).count() == 1
    assert archive.files_for_range(archive.files(spark, str(tmp_path)), entries, 4000 * MS, 5000 * MS).count() == 1


@pytest.mark.parametrize("n", [5, 8, 16, 43])
def test_compressed_waves(spark, tmp_path, n):
    values = np.arange(n) * 77 - 1000
    flags = archive.BIG_ENDIAN | archive.COMPRESSED | archive.SHAPED | 0x40
    wave = event(MS, shuffled(values), flags=flags, dims=b"\1" + struct.pack(">I", n), compressed=b"\0")
    put(tmp_path, "W", 0, data_file([wave, event(2 * MS, INT(4)), event(3 * MS, b"\0" * 8, dtype=12), event(4 * MS, INT(1))[:-3]]), [])
    got = archive.read_events(archive.files(spark, str(tmp_path)), 7, (n,)).collect()
    assert [r.discard for r in got] == [None, "shape", "type"]
    assert got[0]["values"] == values.tolist()


def test_faults(spark, tmp_path):
    put(tmp_path, "CH", 0, b"\0\1" + data_file([])[2:], [])
    with pytest.raises(Exception, match="bad header"):
        archive.read_events(archive.files(spark, str(tmp_path)), 7).collect()


def test_cbor_and_frames(spark):
    assert encode.cbor({"a": [1, -2, 300, 1.5], "b": True, "c": None, "d": "x"}).hex() == "a4616184012119012cfb3ff80000000000006162f56163f661646178"
    df = spark.createDataFrame([(5, 6, bytearray(b"ab"))], "ts_ns bigint, pulse bigint, payload binary")
    (row,) = df.select(encode.download_frame("ts_ns", "pulse", "payload").alias("f")).collect()
    assert bytes(row.f) == struct.pack(">IBQQ", 19, 1, 5, 6) + b"ab" + struct.pack(">I", 19)
    assert encode.download_header({"name": "x"})[:5] == struct.pack(">IB", 13, 0)


@pytest.mark.parametrize("streaming", [False, True])
def test_frames(spark, tmp_path, streaming):
    docs = [encode.events_cbor([(5, 1.5), (2**40, -7)], "f64"), encode.events_cbor([], "f64"), encode.events_cbor([(6, "on"), (7, True), (8, None)], "string")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"".join(encode.binary_frames(docs)))
    df = frames.read_frames(spark, str(tmp_path / "in"), streaming)
    if streaming:
        df.writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
        df = spark.table("frames_seen")
    assert [(r.ts_ns, r.value, r.text) for r in df.orderBy("ts_ns").collect()] == [(5, 1.5, None), (6, None, "on"), (7, 1.0, None), (8, None, None), (2**40, -7.0, None)]


def test_truncated_frames():
    with pytest.raises(ValueError, match="truncated frame"):
        list(frames.bodies(next(encode.binary_frames([b"abcd"]))[:18]))
    with pytest.raises(ValueError, match="CBOR"):
        frames.from_cbor(encode.cbor(["abc", 1])[:-2])
