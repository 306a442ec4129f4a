"""Accounting, pulse maps and status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import MIN, SEC
from .series import with_one_before

SNAP = 10 * MIN

# Status kinds that mean a connection; every other means none.
CONNECTED = (1,)
# Status kinds by number.
STATUS = {
    1: "Opened", 2: "ShutdownCommand", 3: "ChannelRemove", 4: "ProtocolError", 5: "FrequencyQuota", 6: "BandwidthQuota",
    7: "InternalError", 8: "IocTimeout", 9: "NoProtocol", 10: "ProtocolDone", 11: "ConnectFail", 12: "IoError",
    24: "AssignedToAddress", 25: "Pong", 26: "MonitoringSilenceReadStart", 27: "MonitoringSilenceReadTimeout",
    28: "MonitoringSilenceReadUnchanged", 29: "HaveStatusId", 30: "HaveAddress", 31: "MonitoringReadResultExpected",
    32: "MonitoringReadResultUnexpected", 33: "MonitoringReadDiffTime", 34: "MonitoringReadDiffValue",
    35: "PollingReadTimeout", 36: "Ping", 37: "PongTimeout",
}


def account(events: DataFrame, size: Column, snap: int = SNAP) -> DataFrame:
    """(snap_ns, series, count, bytes) of each ten minutes."""
    at = F.expr(f"ts_ns div {snap}") * snap
    return events.groupBy(at.alias("snap_ns"), "series").agg(F.count("*").alias("count"), F.sum(size).alias("bytes"))


def totals(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("snap_ns").agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes"))


def toplist(accounts: DataFrame, by: str, n: int) -> DataFrame:
    """Series with the most events or bytes."""
    sums = accounts.groupBy("series").agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes"))
    return sums.orderBy(F.desc(by), "series").limit(n)


def vote(candidates: DataFrame, pulse: str, ts: str) -> DataFrame:
    """The time that most candidates give for each pulse; the earliest of equals."""
    votes = candidates.groupBy(pulse, ts).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(pulse).orderBy(F.desc("votes"), ts)
    return votes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_interval(points: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, bucket: int) -> DataFrame:
    """Pairs of points and the spans [lo, hi] that hold them: an equi-join on buckets of ``bucket`` values, then the bounds."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.expr(f"{lo} div {bucket}"), F.expr(f"{hi} div {bucket}"))))
    return points.withColumn("_b", F.expr(f"{point} div {bucket}")).join(cut, "_b").filter(F.col(point).between(F.col(lo), F.col(hi))).drop("_b")


def closed(files: DataFrame, channel: str, timebin: str, open_bins: int = 2) -> DataFrame:
    """Files of all but each channel's latest time-bins."""
    w = Window.partitionBy(channel).orderBy(F.desc(timebin))
    return files.withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") > open_bins).drop("_n")


def public_status(kind: Column) -> Column:
    return F.when(kind.isin(*CONNECTED), F.lit("Connect")).otherwise(F.lit("Disconnect"))


def status_name(kind: Column) -> Column:
    """A status kind's name; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[kind]


def status_events(status: DataFrame, beg: int, end: int) -> DataFrame:
    """Status events (series, ts_ns, kind) of [beg, end) and the last before, with ``name`` and ``public``."""
    return with_one_before(status, beg, end).withColumn("name", status_name(F.col("kind"))).withColumn("public", public_status(F.col("kind")))


def pulse_offsets(events: DataFrame, pulse: str, series: str = "series") -> DataFrame:
    """Adds pulse_anchor, the first pulse of the series in ten thousands, and pulse_off from it."""
    first = events.groupBy(F.col(series).alias("_s")).agg(F.min(pulse).alias("_first"))
    out = events.join(first, F.col(series).eqNullSafe(F.col("_s"))).withColumn("pulse_anchor", F.expr("_first div 10000 * 10000"))
    return out.withColumn("pulse_off", F.col(pulse) - F.col("pulse_anchor")).drop("_s", "_first")


def pulse_time(ts: Column) -> Column:
    """A time in ns as (sec, ns, datetime)."""
    sec = F.floor(ts / SEC).cast("long")
    text = F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss")
    return F.struct(sec.alias("sec"), F.pmod(ts, F.lit(SEC)).alias("ns"), F.concat(text, F.lit("."), F.lpad(F.floor(F.pmod(ts, F.lit(SEC)) / 1_000_000).cast("string"), 3, "0"), F.lit("Z")).alias("datetime"))
