"""Ranges, merging and order of event series: DataFrames of (series, ts_ns, value, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import DAY


def in_range(events: DataFrame, beg: int, end: int, beg_exclusive: bool = False) -> DataFrame:
    """Events of [beg, end), or of (beg, end)."""
    low = F.col("ts_ns") > beg if beg_exclusive else F.col("ts_ns") >= beg
    return events.filter(low & (F.col("ts_ns") < end))


def last_before(events: DataFrame, beg: int) -> DataFrame:
    """Each series' last event before ``beg``; one partial row a series and task is shuffled."""
    cols = [c for c in events.columns if c != "series"]
    best = events.filter(F.col("ts_ns") < beg).groupBy("series").agg(F.max_by(F.struct(*cols), "ts_ns").alias("e"))
    return best.select("series", *[F.col(f"e.{c}").alias(c) for c in cols]).select(*events.columns)


def with_one_before(events: DataFrame, beg: int, end: int) -> DataFrame:
    """Events of [beg, end) and, of each series, the last one before."""
    return in_range(events, beg, end).unionByName(last_before(events, beg))


def merge_dedup(events: DataFrame, source: str, tie: str) -> DataFrame:
    """One event for each timestamp of a series: the lowest source's, within it the lowest ``tie``."""
    first = Window.partitionBy("series", "ts_ns").orderBy(F.col(source), F.col(tie))
    return events.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", source)


def merged_read(tiers: Sequence[DataFrame], beg: int, end: int, tie: str) -> DataFrame:
    """Events of [beg, end) and each series' last one before, from several archives of the same series.

    Each archive gives its own range with its last event before; of one time the
    first archive's event stays.  Only the last of the events before stays.
    """
    parts = [with_one_before(t, beg, end).withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)]
    merged = merge_dedup(reduce(DataFrame.unionByName, parts), "_tier", tie)
    return with_one_before(merged, beg, end)


def in_order(events: DataFrame, chunk_ns: int = DAY) -> DataFrame:
    """The events; the query fails where a series has two at one time."""
    marked = with_next(events, chunk_ns)
    fault = F.raise_error(F.concat(F.lit("events are not strictly ordered at "), F.col("ts_ns").cast("string"))).cast("bigint")
    return marked.withColumn("ts_ns", F.when(F.col("next_ns") == F.col("ts_ns"), fault).otherwise(F.col("ts_ns"))).drop("next_ns")


def strictly_later(events: DataFrame, arrival: str) -> DataFrame:
    """Events in order of arrival that are later than all before them."""
    before = Window.partitionBy("series").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_m", F.max("ts_ns").over(before)).filter("_m is null or ts_ns > _m").drop("_m")


def order_violations(events: DataFrame, arrival: str) -> DataFrame:
    """Events that are earlier than the one that arrived just before, with its time."""
    w = Window.partitionBy("series").orderBy(arrival)
    return events.withColumn("prev_ts_ns", F.lag("ts_ns").over(w)).filter(F.col("ts_ns") < F.col("prev_ts_ns"))


def with_next(events: DataFrame, chunk_ns: int = DAY) -> DataFrame:
    """Adds ``next_ns``, the time of a series' next event.

    Windows run over (series, chunk of time); a chunk's last event gets the first
    time of the series' next chunk, from a table with one row a chunk.  So a hot
    series is spread over tasks.
    """
    chunked = events.withColumn("_chunk", F.expr(f"ts_ns div {chunk_ns}"))
    firsts = chunked.groupBy("series", "_chunk").agg(F.min("ts_ns").alias("_first"))
    after = firsts.select(F.col("series").alias("_s"), F.col("_chunk").alias("_c"), F.lead("_first").over(Window.partitionBy("series").orderBy("_chunk")).alias("_after"))
    inside = chunked.withColumn("next_ns", F.lead("ts_ns").over(Window.partitionBy("series", "_chunk").orderBy("ts_ns")))
    joined = inside.join(after, (F.col("series") == F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn("next_ns", F.coalesce("next_ns", "_after")).drop("_s", "_c", "_after", "_chunk")


def with_previous(df: DataFrame, order: Sequence[str], value: str, out: str, chunk_ns: int = DAY, back: bool = True) -> DataFrame:
    """Adds ``out``: ``value`` of a series' row before in ``order``, whose first column is a time; of the row after if not ``back``.

    As in :func:`with_next`, windows run within chunks of time, and a chunk's first
    row gets what the series' chunk before ends with.
    """
    chunked = df.withColumn("_chunk", F.expr(f"{order[0]} div {chunk_ns}")).withColumn("_value", F.struct(value))
    edge = (F.max_by if back else F.min_by)("_value", F.struct(*order))
    step = F.lag if back else F.lead
    beside = step("_edge").over(Window.partitionBy("series").orderBy("_chunk"))
    edges = chunked.groupBy("series", "_chunk").agg(edge.alias("_edge")).select(F.col("series").alias("_s"), F.col("_chunk").alias("_c"), beside.alias("_beside"))
    inside = chunked.withColumn("_inside", step("_value").over(Window.partitionBy("series", "_chunk").orderBy(*order)))
    joined = inside.join(edges, (F.col("series") == F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    return joined.withColumn(out, F.coalesce("_inside", "_beside")[value]).drop("_s", "_c", "_chunk", "_value", "_inside", "_beside")


def collect_limit(events: DataFrame, max_events: int, max_bytes: int | None = None, size: int = 16, chunk_ns: int = DAY) -> DataFrame:
    """Each series' first events, up to a number or an estimated number of bytes (the one that crosses stays).

    Events are numbered within chunks of time, after the number of all in the chunks before.
    """
    chunked = events.withColumn("_chunk", F.expr(f"ts_ns div {chunk_ns}"))
    sizes = chunked.groupBy("series", "_chunk").agg(F.count("*").alias("_m"))
    before = (F.sum("_m").over(Window.partitionBy("series").orderBy("_chunk")) - F.col("_m")).alias("_before")
    first = sizes.select(F.col("series").alias("_s"), F.col("_chunk").alias("_c"), before).filter(F.col("_before") < max_events)
    inside = chunked.withColumn("_n", F.row_number().over(Window.partitionBy("series", "_chunk").orderBy("ts_ns", "event_id")))
    out = inside.join(first, (F.col("series") == F.col("_s")) & (F.col("_chunk") == F.col("_c"))).withColumn("_n", F.col("_n") + F.col("_before")).filter(F.col("_n") <= max_events)
    if max_bytes is not None:
        out = out.filter((F.col("_n") - 1) * size < max_bytes)
    return out.select(*events.columns)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other has not, with ``side``; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def pulse_difference(events: DataFrame, pulse: str) -> DataFrame:
    """Extension: pulse less the pulse of the series' event before."""
    return with_previous(events, ["ts_ns", pulse], pulse, "_before").withColumn("pulse_diff", F.col(pulse) - F.col("_before")).drop("_before")
