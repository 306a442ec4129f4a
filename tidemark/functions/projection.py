"""Values as numbers for binning, and names of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scalar types and the Spark types that hold them.
SCALARS: dict[str, T.DataType] = {
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
    "enum": T.StructType([T.StructField("ix", T.ShortType()), T.StructField("name", T.StringType())]),
}


def to_number(value: Column, kind: T.DataType) -> Column:
    """A value of any type as a double: text by its bytes, enums by index, arrays by the sum of their elements."""
    if isinstance(kind, T.ArrayType):
        return F.aggregate(value, F.lit(0.0), lambda acc, x: acc + to_number(x, kind.elementType))
    if isinstance(kind, T.StringType):
        return F.octet_length(value).cast("double")
    if isinstance(kind, T.StructType):
        return value["ix"].cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    return value.cast("double")


def array_pick(value: Column, i: int) -> Column:
    """Extension: element ``i`` of a wave, from 0; null beyond its end."""
    return F.get(value, F.lit(i))


def array_bins(value: Column, n: int) -> Column:
    """A wave in n slices of its index, as equal as can be: an array of (count, min, max, avg).

    Null elements are left out; a slice without any has count 0 and nulls; a null
    wave is null.
    """
    if n < 1:
        raise ValueError("a wave has one slice at least")
    edge = lambda k: F.floor(k * F.size(value) / n).cast("int")

    def of(k: Column) -> Column:
        part = F.filter(F.slice(value, edge(k) + 1, edge(k + 1) - edge(k)), lambda x: x.isNotNull())
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        avg = F.when(F.size(part) > 0, total / F.size(part))
        return F.struct(F.size(part).alias("count"), F.array_min(part).alias("min"), F.array_max(part).alias("max"), avg.alias("avg"))

    return F.when(value.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of))
