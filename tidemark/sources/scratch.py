"""Steps that are written between shuffles, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/archive/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so that what builds on it several times doesn't compute it anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
