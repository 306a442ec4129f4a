"""Partitioned archives of events and of bins, as Parquet.

Events lie in folders by day and by a bucket of the series, bins by width and
partition (msp) of their layer; a range reads only the folders that it touches.
Within a file rows are sorted, so row groups are skipped by series and time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import addresses
from ..plans.grid import DAY, LAYERS

BUCKETS = 16


def _bucket(series, buckets: int):
    return F.pmod(F.xxhash64(series), F.lit(buckets)).cast("int")


def write_events(events: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Events (series, ts_ns, ...) by day and bucket; a series' day is one file, whatever other series have."""
    placed = events.withColumn("day", F.expr(f"ts_ns div {DAY}")).withColumn("bucket", _bucket("series", buckets))
    dealt = placed.repartition("day", "bucket").sortWithinPartitions("day", "bucket", "series", "ts_ns")
    dealt.write.mode(mode).partitionBy("day", "bucket").parquet(path)


def read_events(spark: SparkSession, path: str, beg: int, end: int, series: Sequence | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Events of [beg, end), of some series only if they are given: folders are pruned by day and bucket."""
    held = spark.read.parquet(path).filter(F.col("day").between(beg // DAY, -(-end // DAY) - 1) & (F.col("ts_ns") >= beg) & (F.col("ts_ns") < end))
    if series is not None:
        known = spark.createDataFrame([(s,) for s in series], held.select("series").schema)
        # One row for each bucket at most reaches the driver.
        wanted = [r[0] for r in known.select(_bucket("series", buckets)).distinct().collect()]
        held = held.filter(F.col("bucket").isin(wanted) & F.col("series").isin(list(series)))
    return held.drop("day", "bucket")


def write_bins(bins: DataFrame, path: str, layer: str, mode: str = "append") -> None:
    """Bins of a layer's width by width and msp, with lsp as a column."""
    width, _ = LAYERS[layer]
    placed = addresses(bins, layer).withColumn("width", F.lit(width))
    placed.repartition("width", "msp").sortWithinPartitions("width", "msp", "series", "lsp").write.mode(mode).partitionBy("width", "msp").parquet(path)


def read_bins(spark: SparkSession, path: str, layer: str, beg: int, end: int) -> DataFrame:
    """Bins of a layer that begin in [beg, end): only the partitions that hold some are read."""
    width, length = LAYERS[layer]
    first, last = beg // width // length, (-(-end // width) - 1) // length
    held = spark.read.parquet(path).filter((F.col("width") == width) & F.col("msp").between(first, last))
    return held.filter((F.col("ts1") >= beg) & (F.col("ts1") < end)).drop("width", "msp", "lsp")
