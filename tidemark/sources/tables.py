"""Event series from tables, files and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import MS, SEC


def nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def events(spark: SparkSession, sf_dir: str, series: str = "event_type", beg: int | None = None, end: int | None = None) -> DataFrame:
    """(series, ts_ns, value, event_id) of the events table; values in hundredths, so that sums are exact.

    ``beg`` and ``end`` (ns) bound the stored time, so that the scan skips what is outside.
    """
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    stored = df.schema["ts"].dataType
    at = lambda ns: F.timestamp_micros(F.lit(ns // 1000)).cast(stored)
    df = df if beg is None else df.filter(F.col("ts") >= at(beg))
    df = df if end is None else df.filter(F.col("ts") < at(-(-end // 1000) * 1000))
    return df.select(F.col(series).alias("series"), nanos(F.col("ts")).alias("ts_ns"), F.round(F.col("value") * 100).cast("long").alias("value"), "event_id")


def test_series(spark: SparkSession, kind: str, beg: int, end: int) -> DataFrame:
    """Generated series: "i32-v00", "i32-v01", "f64-wave-v00" or "i16-wave-v00"."""
    step = {"i32-v00": 1000 * MS, "i32-v01": 500 * MS, "f64-wave-v00": 100 * MS, "i16-wave-v00": 100 * MS}[kind]
    if kind == "i32-v01":
        end = min(end, 86_400 * SEC)
    ts = spark.range(-(-beg // step), -(-end // step)).select((F.col("id") * step).alias("ts_ns"))
    if kind == "i32-v00":
        value = F.pmod(F.floor(F.col("ts_ns") / (100 * MS)), F.lit(1000)).cast("int")
    elif kind == "i32-v01":
        value = F.floor(F.col("ts_ns") / step).cast("int")
    else:
        wave = F.sin(F.col("ts_ns") / step) + 2
        value = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (F.cos(-F.pi() + 2 * F.pi() / 20 * i) + 1.1) * wave)
        if kind == "i16-wave-v00":
            value = value.cast("array<smallint>")
    return ts.select(F.lit(kind).alias("series"), "ts_ns", value.alias("value"))
