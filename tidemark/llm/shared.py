"""Helpers that several operators share: scratch folders, Arrow access, prefix sums."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs only the tasks of the current
    step, and fixes whatever depends on the partitioning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them, without a copy; null counts as empty."""
    array = plain(array)
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Cut rows into spans of about ``size`` bytes, one row at least."""
    spans, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        spans.append((a, b))
        a = b
    return spans


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 (public domain) over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def running_total(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None, name: str = "running") -> DataFrame:
    """Add ``out``: the sum of ``value`` over this row and all before it in ``order``, within ``group``.

    No window over a whole group: rows are range-partitioned by (group, order),
    partitions are summed, the few sums give each partition's start, and only
    then rows add up within their partition.  A hot group is spread over
    partitions.  ``order`` must tell rows apart for a repeatable result.
    Columns ``_part`` and ``_row`` (unique, in order) stay in the result.
    """
    spark = df.sparkSession
    keys = ([F.col(group).asc_nulls_last()] if group else []) + order
    ranged = df.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys)
    held = materialise(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    by = ["_part", "_group"]
    marked = held.withColumn("_group", F.col(group) if group else F.lit(0))
    sums = marked.groupBy(*by).agg(F.sum(value).alias("_sum"))
    # One row for each partition and group in it: partitions + groups - 1 rows at most.
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_sum")).select("_part", F.col("_group").alias("_g"), "_before")
    inside = marked.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)))
    joined = inside.join(before.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_p", "_g", "_group", "_before")
