import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.projection import array_bins
from tidemark.operators import binning, ingest, limits, series
from tidemark.plans.grid import MS, Grid
from tidemark.plans.layers import CacheUsage
from tidemark.sources import encode, store
from tidemark.sources.tables import test_series as generated

A = [(102, 2.0), (104, 2.4), (111, 1.0), (112, 1.2), (113, 1.4)]


def frame(spark, rows, name="a"):
    return spark.createDataFrame([(name, t * MS, float(v)) for t, v in rows], "series string, ts_ns bigint, value double")


def bins(spark, rows, beg, end, **kw):
    got = binning.bin_events(frame(spark, rows), Grid(10 * MS, beg // 10, end // 10), **kw).orderBy("ts1").collect()
    return [(r["cnt"], r["min"], r["max"], round(r["avg"], 4)) for r in got]


@pytest.mark.parametrize(
    "rows,beg,end,kw,want",
    [
        ([(103, 2.0)], 110, 130, {}, [(0, 2, 2, 2), (0, 2, 2, 2)]),
        (A, 100, 120, {}, [(2, 2.0, 2.4, 2.3), (3, 1.0, 2.4, 1.44)]),
        (A, 100, 120, {"final": False, "zero_count": False}, [(2, 2.0, 2.4, 2.3), (3, 1.0, 2.4, 1.5333)]),
        ([*A, (146, 1.3), (148, 1.2)], 100, 150, {}, [(2, 2.0, 2.4, 2.3), (3, 1.0, 2.4, 1.44), (0, 1.4, 1.4, 1.4), (0, 1.4, 1.4, 1.4), (2, 1.2, 1.4, 1.34)]),
        ([(109, 50), (111, 40)], 110, 120, {}, [(1, 40, 50, 41)]),
        ([(109, 50), (110, 40)], 110, 120, {}, [(1, 40, 40, 40)]),
    ],
)
def test_bins(spark, rows, beg, end, kw, want):
    assert bins(spark, rows, beg, end, **kw) == want


def test_nan_never_replaces(spark):
    assert bins(spark, [(100, 1.0), (103, math.nan), (105, 2.0)], 100, 110)[0][:3] == (3, 1.0, 2.0)


def test_hot_series_in_chunks_equals_one_window(spark):
    rnd = random.Random(1)
    rows = [(t, rnd.random()) for t in sorted(rnd.sample(range(1000), 200))]
    assert bins(spark, rows, 100, 900) == bins(spark, rows, 100, 900, chunk_ns=7 * MS)


def test_rebin_of_bins_equals_bins(spark):
    rnd = random.Random(2)
    # From the grid's begin on: a bin that is covered in part weighs as a whole when it is binned again.
    df = frame(spark, [(t, rnd.random()) for t in [0, *sorted(rnd.sample(range(1, 1000), 50))]])
    fine = binning.rebin(binning.bin_events(df, Grid(10 * MS, 0, 100)), 100 * MS, zero_count=True)
    for a, b in zip(fine.orderBy("ts1").collect(), binning.bin_events(df, Grid(100 * MS, 0, 10)).orderBy("ts1").collect()):
        assert (a["ts1"], a["cnt"], a["min"], a["max"], a["lst"]) == (b["ts1"], b["cnt"], b["min"], b["max"], b["lst"])
        assert a["avg"] == pytest.approx(b["avg"])


def test_merge_of_overlapping_sources(spark):
    inputs = [[400, 405, 408, 410, 414, 416, 417, 418, 419], [402, 404, 406, 411, 412, 413], [401, 403, 406, 407, 409, 413, 414, 415]]
    rows = [("a", t, float(i), i, n) for i, ts in enumerate(inputs) for n, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "series string, ts_ns bigint, value double, src int, seq int")
    got = sorted((r["ts_ns"], r["value"]) for r in series.merge_dedup(df, "src", "seq").collect())
    assert [t for t, _ in got] == list(range(400, 420))
    assert dict(got)[406] == 1.0 and dict(got)[414] == 0.0


def test_ranges(spark):
    df = frame(spark, [(t, t) for t in range(8, 18)])
    times = lambda d: sorted(r["ts_ns"] // MS for r in d.collect())
    assert times(series.in_range(df, 10 * MS, 20 * MS)) == list(range(10, 18))
    assert times(series.with_one_before(df, 10 * MS, 20 * MS)) == list(range(9, 18))
    assert times(series.with_one_before(df, 50 * MS, 60 * MS)) == [17]
    assert times(series.in_range(df, 10 * MS, 12 * MS, beg_exclusive=True)) == [11]


def test_thinning(spark):
    rows = [("a", t * MS, 1, t) for t in (0, 1, 4, 10, 11, 19, 21)] + [("b", 5 * MS, 1, 99)]
    df = spark.createDataFrame(rows, "series string, ts_ns bigint, value bigint, event_id bigint")
    assert sorted((r["series"], r["ts_ns"] // MS) for r in ingest.thin(df, 10 * MS).collect()) == [("a", 0), ("a", 10), ("a", 21), ("b", 5)]
    forced = ingest.thin(df, 10 * MS, forced=F.col("event_id").isin(4, 11))
    assert forced.columns == df.columns
    # The rate counts from forced events on.
    assert sorted((r["series"], r["ts_ns"] // MS) for r in forced.collect()) == [("a", 0), ("a", 4), ("a", 11), ("a", 21), ("b", 5)]
    unknown = ingest.thin(df, 10 * MS, forced=F.lit(None).cast("boolean"))
    assert unknown.count() == 4 and ingest.thin(df.limit(0), 10 * MS, forced=F.lit(True)).count() == 0


def test_array_bins(spark):
    df = spark.createDataFrame([(1, [1, 2, None, 4, 5]), (2, [7]), (3, []), (4, None), (5, [None, None])], "id int, w array<int>")
    got = {r["id"]: r["x"] and [tuple(y) for y in r["x"]] for r in df.select("id", array_bins(F.col("w"), 2).alias("x")).collect()}
    none = (0, None, None, None)
    assert got == {1: [(2, 1, 2, 1.5), (2, 4, 5, 4.5)], 2: [none, (1, 7, 7, 7.0)], 3: [none, none], 4: None, 5: [none, none]}
    with pytest.raises(ValueError):
        array_bins(F.col("w"), 0)


def test_tiers(spark):
    rows = [("a", t * MS, v, i) for i, (t, v) in enumerate([(0, 1), (2, 1), (3, 2), (1, 9), (12, 3)])]
    df = spark.createDataFrame(rows, "series string, ts_ns bigint, value bigint, event_id bigint")
    got = sorted((r["tier"], r["event_id"]) for r in ingest.write_tiers(df, {"short": 0, "long": 10 * MS}).collect())
    assert got == [("long", 0), ("long", 4), ("short", 0), ("short", 2), ("short", 4)]


def test_expand_and_empty(spark):
    grid = Grid(10 * MS, 10, 15)
    got = binning.expand(binning.bin_events(frame(spark, [*A, (146, 1.3)]), grid, zero_count=False), grid).orderBy("ts1").collect()
    assert [(r["ts1"] // MS, r["cnt"]) for r in got] == [(100, 2), (110, 3), (120, 0), (130, 0), (140, 1)]
    assert binning.bin_events(frame(spark, []), grid).count() == 0


def test_edge_check_returns_every_kind_of_fault(spark):
    rows = [(0, 2, 1, 1.0, 3.0, 3.0 + 1e-12, 2.0), (2, 4, 1, 1.0, 3.0, 3.1, 2.0), (6, 8, 1, 1.0, 3.0, 2.0, 2.0), (8, 10, 0, 2.0, 3.0, 2.0, 2.0), (10, 12, 0, 2.0, 2.0, 2.0, 2.0)]
    faulty = spark.createDataFrame([("a", *r) for r in rows], "series string, ts1 bigint, ts2 bigint, cnt bigint, min double, max double, avg double, lst double")
    assert sorted(r["ts1"] for r in binning.edge_faults(faulty).collect()) == [2, 6, 8]


def test_errors(spark):
    with pytest.raises(Exception, match="not strictly ordered"):
        series.in_order(frame(spark, [(1, 1), (1, 2)])).collect()
    assert series.in_order(frame(spark, [(1, 1), (2, 2)])).count() == 2
    wide = spark.createDataFrame([("a", 0, 20, 1, 1.0, 1.0, 1.0, 1.0, True)], "series string, ts1 bigint, ts2 bigint, cnt bigint, min double, max double, avg double, lst double, fnl boolean")
    with pytest.raises(Exception, match="over the edge"):
        binning.rebin(wide, 10).collect()


def test_limits_and_schemes():
    assert limits.event_limits() == limits.Limits(80_000, 8 << 20)
    assert limits.event_limits(10**9, 1, large=True) == limits.Limits(4_000_000, 1)
    assert limits.bin_limit() == 2500
    assert limits.scheme("unweightedScalar") == ("fullValue", False) and limits.scheme("timeWeightedScalar") == ("timeWeightedScalar", True)
    with pytest.raises(ValueError):
        limits.scheme("other")
    assert ingest.quiet_times({"short": "monitor", "medium": 5, "long": None}) == {"short": 0, "medium": 5_000_000_000}


def test_neighbours_in_chunks_equal_one_window(spark):
    rnd = random.Random(6)
    df = frame(spark, [(t, rnd.random()) for t in rnd.sample(range(500), 60)])
    want = dict(zip(sorted(r["ts_ns"] for r in df.collect()), [None] + [r["value"] for r in df.orderBy("ts_ns").collect()]))
    got = series.with_previous(df, ["ts_ns"], "value", "was", 7 * MS)
    assert {r["ts_ns"]: r["was"] for r in got.collect()} == want
    numbered = df.withColumn("event_id", df["ts_ns"])
    assert sorted(r["ts_ns"] for r in series.collect_limit(numbered, 17, chunk_ns=7 * MS).collect()) == sorted(want)[:17]


def test_archives_are_pruned(spark, tmp_path):
    day = 86_400_000
    df = frame(spark, [(d * day + 5, d) for d in range(6)]).unionByName(frame(spark, [(3 * day, 9)], "b"))
    store.write_events(df, f"file://{tmp_path}/e")
    got = store.read_events(spark, f"file://{tmp_path}/e", 2 * day * MS, 4 * day * MS, ["a"])
    assert sorted(r["value"] for r in got.collect()) == [2.0, 3.0]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "bucket" in plan


def test_layers_fill_holes_and_rebin(spark):
    df = frame(spark, [(t, t % 7) for t in range(0, 400, 3)])
    fine, coarse = Grid(10 * MS, 0, 40), Grid(100 * MS, 0, 4)
    held = binning.bin_events(df, fine).filter("ts1 % 30000000 <> 0")
    want = binning.bin_events(df, coarse).select("ts1", "cnt", "min", "max", "lst").orderBy("ts1").collect()
    got = binning.layered(df, {10 * MS: held}, coarse, CacheUsage.READ).select("ts1", "cnt", "min", "max", "lst").orderBy("ts1").collect()
    assert got == want
    assert binning.layered(df, {}, coarse, allow_events=False).count() == 0


def test_encoders():
    assert encode.events_json([(1_500_000_001, 1), (2_000_000_000, 2)]) == '{"tsAnchor": 1, "tsMs": [500, 1000], "tsNs": [1, 0], "values": [1, 2]}'
    assert next(encode.json_frames(["{}"])) == b"              2\n{}\n"
    assert next(encode.binary_frames([b"abc"])) == b"\x03\0\0\0" + b"\0" * 12 + b"abc" + b"\0" * 5


def test_generators(spark):
    whole = generated(spark, "i16-wave-v00", 0, 10**9).orderBy("ts_ns").first()["value"]
    assert len(whole) == 21 and whole[0] == 0 and whole[10] == 4
    wave = generated(spark, "f64-wave-v00", 0, 10**9)
    assert wave.count() == 10 and len(wave.first()["value"]) == 21
    assert generated(spark, "i32-v01", 0, 10**20 // 10**6).filter("ts_ns >= 86400 * 1000000000L").count() == 0
