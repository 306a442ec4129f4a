"""The registered queries over the driver's tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.projection import array_bins, array_pick, to_number
from .operators import binning, catalog, ingest, limits, series, usage
from .plans.grid import DAY, HOUR, LAYERS, MIN, SEC, Grid, by_count, by_width
from .plans.layers import CacheUsage, day_sources
from .sources import store
from .sources.encode import download_frame, with_offsets
from .sources.scratch import scratch
from .sources.tables import events, test_series

# The events table's month.
BEG = 1_704_067_200 * SEC
END = BEG + 30 * DAY
MID, LATE = BEG + 10 * DAY, BEG + 12 * DAY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "WITH ev AS (SELECT event_type AS series, epoch_us(ts) * 1000 AS ts_ns, CAST(round(value * 100) AS BIGINT) AS value, event_id, user_id FROM events)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- ranges

ROWS = "series, ts_ns, value, event_id"


@query(f"{EV} SELECT {ROWS} FROM ev WHERE ts_ns >= {MID} AND ts_ns < {LATE}")
def events_range(spark, d):
    return series.in_range(events(spark, d, beg=MID, end=LATE), MID, LATE)


@query(f"{EV}, b AS (SELECT series, max(ts_ns) AS m FROM ev WHERE ts_ns < {MID} GROUP BY 1) SELECT {ROWS} FROM ev JOIN b USING (series) WHERE ts_ns < {LATE} AND ts_ns >= m")
def events_one_before(spark, d):
    return series.with_one_before(events(spark, d, end=LATE), MID, LATE)


@query(f"{EV}, b AS (SELECT min(ts_ns) AS m FROM ev WHERE ts_ns >= {MID}) SELECT {ROWS} FROM ev, b WHERE ts_ns > m AND ts_ns < {LATE}")
def events_beg_excl(spark, d):
    ev = events(spark, d, beg=MID)
    # One row: the time of the first event, which the open range leaves out.
    first = ev.agg(F.min("ts_ns").alias("_first"))
    return series.in_range(ev, MID, LATE).join(F.broadcast(first), F.col("ts_ns") > F.col("_first")).drop("_first")


@query(f"{EV} SELECT series, max(ts_ns) AS ts_ns, arg_max(value, ts_ns) AS value, arg_max(event_id, ts_ns) AS event_id FROM ev WHERE ts_ns < {MID} GROUP BY 1")
def events_last_before(spark, d):
    return series.last_before(events(spark, d, end=MID), MID)


@query(f"""{EV}, u AS (SELECT *, 0 AS src FROM ev WHERE ts_ns < {LATE} UNION ALL SELECT series, ts_ns, value + 1, event_id, user_id, 1 FROM ev WHERE ts_ns >= {MID}),
    r AS (SELECT *, row_number() OVER (PARTITION BY series, ts_ns ORDER BY src, event_id) AS n FROM u) SELECT {ROWS} FROM r WHERE n = 1""")
def events_merge_dedup(spark, d):
    ev = events(spark, d)
    # Two archives that overlap in time.
    a = ev.filter(F.col("ts_ns") < LATE).withColumn("src", F.lit(0))
    b = ev.filter(F.col("ts_ns") >= MID).withColumn("value", F.col("value") + 1).withColumn("src", F.lit(1))
    return series.merge_dedup(a.unionByName(b), "src", "event_id")


def _by_value(ev: DataFrame) -> DataFrame:
    """As if events had arrived in order of value: not in order of time."""
    return ev.withColumn("arrival", F.struct("value", "event_id"))


@query(f"""{EV}, m AS (SELECT *, max(ts_ns) OVER (PARTITION BY series ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev)
    SELECT {ROWS} FROM m WHERE m IS NULL OR ts_ns > m""")
def events_strictly_later(spark, d):
    return series.strictly_later(_by_value(events(spark, d)), "arrival").drop("arrival")


@query(f"{EV}, m AS (SELECT *, lag(ts_ns) OVER (PARTITION BY series ORDER BY value, event_id) AS prev_ts_ns FROM ev) SELECT {ROWS}, prev_ts_ns FROM m WHERE ts_ns < prev_ts_ns")
def events_monotonic_violations(spark, d):
    return series.order_violations(_by_value(events(spark, d)), "arrival").drop("arrival")


@query(f"{EV}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ns, event_id) AS n FROM ev) SELECT {ROWS} FROM n WHERE n <= 100")
def collect_limit_events(spark, d):
    return series.collect_limit(events(spark, d), 100)


@query(f"{EV}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ns, event_id) AS n FROM ev) SELECT {ROWS} FROM n WHERE (n - 1) * 16 < 1000")
def collect_limit_bytes(spark, d):
    return series.collect_limit(events(spark, d), 80_000, 1000)


@query(f"{EV} SELECT event_id, series, 'left' AS side FROM ev WHERE ts_ns < {MID} UNION ALL SELECT event_id, series, 'right' FROM ev WHERE ts_ns >= {LATE}")
def stream_compare(spark, d):
    ev = events(spark, d)
    return series.differences(ev.filter(F.col("ts_ns") < LATE).select("event_id", "series"), ev.filter(F.col("ts_ns") >= MID).select("event_id", "series"))


@query(f"{EV} SELECT series, ts_ns, event_id, event_id - lag(event_id) OVER (PARTITION BY series ORDER BY ts_ns, event_id) AS pulse_diff FROM ev")
def pulse_id_diff(spark, d):
    return series.pulse_difference(events(spark, d).drop("value"), "event_id")


# ---------------------------------------------------------------- projections


@query("SELECT event_id, CAST(strlen(event_type) AS DOUBLE) AS type_bytes, CAST(value > 50 AS INTEGER) * 1.0::DOUBLE AS above, value FROM events")
def events_to_number(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet")
    above = (F.col("value") > 50).alias("above")
    t = df.select("event_id", "event_type", above, "value")
    return t.select("event_id", to_number(F.col("event_type"), t.schema["event_type"].dataType).alias("type_bytes"), to_number(F.col("above"), t.schema["above"].dataType).alias("above"), to_number(F.col("value"), t.schema["value"].dataType).alias("value"))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, embedding[4] AS picked FROM embeddings")
def waveform_sum(spark, d):
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    return df.select("vec_id", F.round(to_number(F.col("embedding"), df.schema["embedding"].dataType), 6).alias("total"), array_pick(F.col("embedding"), 3).alias("picked"))


@query("""SELECT vec_id, k AS bin, CAST(len(part) AS BIGINT) AS n, CAST(list_min(part) AS DOUBLE) AS low, CAST(list_max(part) AS DOUBLE) AS high, round(list_avg(part), 6) AS mean
    FROM (SELECT vec_id, k, list_slice(CAST(embedding AS DOUBLE[]), k * len(embedding) // 5 + 1, (k + 1) * len(embedding) // 5) AS part FROM embeddings, range(5) r(k) WHERE embedding IS NOT NULL)""")
def waveform_bins(spark, d):
    bins = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(array_bins(F.col("embedding"), 5)).alias("bin", "x"))
    return bins.select("vec_id", F.col("bin").cast("long").alias("bin"), F.col("x.count").cast("long").alias("n"), F.col("x.min").cast("double").alias("low"), F.col("x.max").cast("double").alias("high"), F.round("x.avg", 6).alias("mean"))


@query("SELECT 'i32-v00' AS series, i * 1000000000 AS ts_ns, CAST((i * 10) % 1000 AS INTEGER) AS value FROM range(100, 160) t(i)")
def generated_series(spark, d):
    return test_series(spark, "i32-v00", 100 * SEC, 160 * SEC)


# ---------------------------------------------------------------- bins


def bins_sql(g: Grid, key: str = "event_type", where: str = "true", zero: bool = True) -> str:
    w = g.width
    return f"""
    WITH ev AS (SELECT {key} AS series, epoch_us(ts) * 1000 AS ts_ns, CAST(round(value * 100) AS BIGINT) AS value, event_id FROM events WHERE {where}),
    f AS (SELECT series, ts_ns, arg_min(value, event_id) AS value FROM ev WHERE ts_ns < {g.end} GROUP BY 1, 2),
    n AS (SELECT *, lead(ts_ns) OVER (PARTITION BY series ORDER BY ts_ns) AS nx FROM f),
    s AS (SELECT *, greatest(ts_ns, {g.beg}) AS sb, least(coalesce(nx, {g.end}), {g.end}) AS se FROM n),
    p AS (SELECT *, unnest(range(sb // {w}, (se - 1) // {w} + 1)) AS bin FROM s WHERE se > sb),
    q AS (SELECT *, least(se, (bin + 1) * {w}) - greatest(sb, bin * {w}) AS dt FROM p)
    SELECT series, bin * {w} AS ts1, (bin + 1) * {w} AS ts2,
        CAST(sum(CASE WHEN ts_ns >= greatest(bin * {w}, {g.beg}) THEN 1 ELSE 0 END) AS BIGINT) AS cnt,
        min(value) / 100.0::DOUBLE AS min, max(value) / 100.0::DOUBLE AS max,
        round(CAST(sum(value::HUGEINT * dt) AS DOUBLE) / CAST(sum(dt) AS DOUBLE) / 100, 6) AS avg, arg_max(value, ts_ns) / 100.0::DOUBLE AS lst, true AS fnl
    FROM q GROUP BY series, bin {"" if zero else "HAVING sum(CASE WHEN ts_ns >= greatest(bin * " + str(w) + ", " + str(g.beg) + ") THEN 1 ELSE 0 END) > 0"}"""


def _ordered(spark, d, key: str = "event_type", where: str | None = None) -> DataFrame:
    """Events with one value for each time of a series, in hundredths."""
    ev = events(spark, d, key)
    ev = ev if where is None else ev.filter(where)
    return ev.groupBy("series", "ts_ns").agg(F.min_by("value", "event_id").alias("value"))


def _bins(spark, d, grid: Grid, **kw) -> DataFrame:
    zero = kw.pop("zero", True)
    return _round(binning.bin_events(_ordered(spark, d, **kw), grid, zero_count=zero, scale=100), "avg")


HOURLY, SIX = by_width(BEG, END, HOUR), by_width(MID, LATE, 10 * MIN)
TWENTY = by_count(BEG, END)
DAILY = by_width(BEG, END, DAY)


@query(bins_sql(HOURLY))
def bins_by_width_1h(spark, d):
    return _bins(spark, d, HOURLY)


@query(bins_sql(TWENTY))
def bins_by_count_20(spark, d):
    return _bins(spark, d, TWENTY)


@query(bins_sql(DAILY, "user_id"))
def bins_user_series_1d(spark, d):
    return _bins(spark, d, DAILY, key="user_id")


@query(bins_sql(SIX))
def bins_zero_count(spark, d):
    return _bins(spark, d, SIX)


@query(bins_sql(SIX, zero=False))
def bins_no_zero_count(spark, d):
    return _bins(spark, d, SIX, zero=False)


@query(bins_sql(SIX, where=f"epoch_us(ts) * 1000 >= {MID + DAY}"))
def bins_leading_gap(spark, d):
    return _bins(spark, d, SIX, where=f"ts_ns >= {MID + DAY}")


@query(bins_sql(HOURLY).replace("epoch_us(ts) * 1000 AS ts_ns", f"epoch_us(ts) * 1000 // {HOUR} * {HOUR} AS ts_ns"))
def bins_edge_aligned(spark, d):
    ev = events(spark, d).withColumn("ts_ns", F.expr(f"ts_ns div {HOUR}") * HOUR).groupBy("series", "ts_ns").agg(F.min_by("value", "event_id").alias("value"))
    return _round(binning.bin_events(ev, HOURLY, scale=100), "avg")


@query("""WITH f AS (%s), c AS (SELECT *, ts1 // %d AS bin FROM f)
    SELECT series, bin * %d AS ts1, (bin + 1) * %d AS ts2, CAST(sum(cnt) AS BIGINT) AS cnt, min(min) AS min, max(max) AS max, round(sum(avg * (ts2 - ts1)) / sum(ts2 - ts1), 4) AS avg, arg_max(lst, ts1) AS lst, true AS fnl
    FROM c GROUP BY series, bin HAVING sum(cnt) > 0""" % (bins_sql(HOURLY), DAY, DAY, DAY))
def rebin_1h_to_1d(spark, d):
    return binning.rebin(_round(binning.bin_events(_ordered(spark, d), HOURLY, scale=100), "avg"), DAY).withColumn("avg", F.round("avg", 4))


@query(bins_sql(HOURLY))
def gapfill_bins(spark, d):
    ev = _ordered(spark, d)
    cached = binning.bin_events(ev, HOURLY, scale=100).filter(f"(ts1 div {HOUR}) % 5 >= 2")
    return _round(binning.gap_fill(cached, ev, HOURLY, scale=100), "avg")


EXPANDED = Grid(10 * MIN, MID // (10 * MIN), LATE // (10 * MIN))


@query(f"""WITH b AS ({bins_sql(SIX, zero=False)}), l AS (SELECT *, coalesce(lead(ts1) OVER (PARTITION BY series ORDER BY ts1), {EXPANDED.end}) AS nx FROM b),
    h AS (SELECT series, unnest(range(ts2, nx, {EXPANDED.width})) AS ts1, lst FROM l)
    SELECT series, ts1, ts2, cnt, min, max, avg, lst, fnl FROM b UNION ALL SELECT series, ts1, ts1 + {EXPANDED.width}, 0, lst, lst, lst, lst, true FROM h""")
def bins_expand(spark, d):
    return binning.expand(_bins(spark, d, SIX, zero=False), EXPANDED)


@query(f"""WITH b AS (SELECT series, ts1, ts2, lst, min, max, CASE WHEN ts1 // {HOUR} % 13 = 0 THEN 0 ELSE cnt END AS cnt, avg + CASE WHEN ts1 // {HOUR} % 11 = 0 THEN 1000 ELSE 0 END AS avg FROM ({bins_sql(HOURLY)}) WHERE ts1 // {HOUR} % 5 >= 2),
    p AS (SELECT *, lag(ts2) OVER (PARTITION BY series ORDER BY ts1) AS prev FROM b)
    SELECT series, ts1 FROM p WHERE prev <> ts1 OR avg < min - 1e-9 OR avg > max + 1e-9 OR (cnt = 0 AND (min <> lst OR max <> lst))""")
def bins_edge_check(spark, d):
    hour = F.expr(f"ts1 div {HOUR}")
    bins = _bins(spark, d, HOURLY).filter(hour % 5 >= 2)
    faulty = bins.withColumn("cnt", F.when(hour % 13 == 0, 0).otherwise(F.col("cnt"))).withColumn("avg", F.col("avg") + F.when(hour % 11 == 0, 1000).otherwise(0))
    return binning.edge_faults(faulty).select("series", "ts1")


@query(f"""WITH b AS (SELECT * FROM ({bins_sql(HOURLY)}) WHERE ts1 // {HOUR} % 7 >= 3 AND cnt > 0),
    l AS (SELECT *, ts1 // {DAY} AS bin, lag(lst) OVER (PARTITION BY series ORDER BY ts1) AS before, min(ts1) OVER (PARTITION BY series, ts1 // {DAY}) AS first FROM b),
    s AS (SELECT *, CASE WHEN ts1 = first AND ts1 > bin * {DAY} THEN before END AS seed FROM l)
    SELECT series, bin * {DAY} AS ts1, (bin + 1) * {DAY} AS ts2, CAST(sum(cnt) AS BIGINT) AS cnt, least(min(min), min(seed)) AS min, greatest(max(max), max(seed)) AS max,
    round(sum(avg * (ts2 - ts1)) / sum(ts2 - ts1), 4) AS avg, arg_max(lst, ts1) AS lst, true AS fnl FROM s GROUP BY series, bin""")
def rebin_with_holes(spark, d):
    fine = _bins(spark, d, HOURLY, zero=False).filter(F.expr(f"ts1 div {HOUR}") % 7 >= 3)
    return binning.rebin(fine, DAY).withColumn("avg", F.round("avg", 4))


@query(ORACLES["rebin_1h_to_1d"])
def layered_bins(spark, d):
    """Days from the hourly layer, whose holes are filled from events."""
    ev = _ordered(spark, d)
    hourly = _round(binning.bin_events(ev, HOURLY, scale=100), "avg").filter(f"(ts1 div {HOUR}) % 5 >= 2")
    return binning.layered(ev, {HOUR: hourly}, DAILY, CacheUsage.READ, scale=100).filter("cnt > 0").withColumn("avg", F.round("avg", 4))


@query(f"SELECT * FROM ({bins_sql(TWENTY)}) WHERE (ts1 - {TWENTY.beg}) // {TWENTY.width} < {limits.bin_limit()}")
def binned_served(spark, d):
    """A request without a cache: the grid by count, bins from events, the limit of bins."""
    bins = _round(binning.layered(_ordered(spark, d), {}, TWENTY, scale=100), "avg")
    return bins.filter((F.col("ts1") - TWENTY.beg) / TWENTY.width < limits.bin_limit())


@query(f"SELECT * FROM ({bins_sql(HOURLY)}) WHERE ts1 >= {MID} AND ts1 < {LATE}")
def bins_store_scan(spark, d):
    path = scratch(spark, "bins")
    store.write_bins(_bins(spark, d, HOURLY), path, "Hour1")
    return store.read_bins(spark, path, "Hour1", MID, LATE)


@query(f"{EV} SELECT {ROWS} FROM ev WHERE ts_ns >= {MID} AND ts_ns < {LATE} AND series IN ('click', 'purchase')")
def events_store_scan(spark, d):
    path = scratch(spark, "events")
    store.write_events(events(spark, d), path)
    return store.read_events(spark, path, MID, LATE, ["click", "purchase"]).select("series", "ts_ns", "value", "event_id")


@query(f"""{EV}, u AS (SELECT *, 0 AS tier FROM ev WHERE event_id % 5 = 0 AND ts_ns >= {MID - DAY} UNION ALL SELECT series, ts_ns, value + 1, event_id, user_id, 1 FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT series, ts_ns, value + 2, event_id, user_id, 2 FROM ev WHERE event_id % 3 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY series, ts_ns ORDER BY tier, event_id) AS n FROM u), m AS (SELECT * FROM r WHERE n = 1 AND ts_ns < {LATE}),
    b AS (SELECT series, max(ts_ns) AS last FROM m WHERE ts_ns < {MID} GROUP BY 1)
    SELECT {ROWS} FROM m LEFT JOIN b USING (series) WHERE ts_ns >= {MID} OR ts_ns = last""")
def events_merged_read(spark, d):
    ev = events(spark, d, end=LATE)
    tiers = [ev.filter(F.col("event_id") % 5 == 0).filter(F.col("ts_ns") >= MID - DAY), ev.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1), ev.filter("event_id % 3 = 0").withColumn("value", F.col("value") + 2)]
    return series.merged_read(tiers, MID, LATE, "event_id")


@query(f"{EV}, c AS (SELECT series, count(*) AS n FROM ev WHERE ts_ns >= {MID} AND ts_ns < {LATE} GROUP BY 1) SELECT series, least(n, 100) AS events, n <= 100 AS range_final FROM c")
def events_response_flags(spark, d):
    ev = series.in_range(events(spark, d, beg=MID, end=LATE), MID, LATE)
    most = limits.event_limits(events=100)
    return limits.summary(ev, series.collect_limit(ev, most.events, most.bytes))


ROLLED = [10 * MIN, HOUR, DAY]


def _rolled(spark, d) -> DataFrame:
    return binning.roll_up(_ordered(spark, d), ROLLED, BEG, END, scale=100)


ROLLED_SQL = " UNION ALL ".join(f"SELECT series, ts1, ts2, cnt, min, max, lst, {w} AS width FROM ({bins_sql(by_width(BEG, END, w), zero=False)})" for w in ROLLED)


@query(ROLLED_SQL)
def rollup_cascade(spark, d):
    return _rolled(spark, d).select("series", "ts1", "ts2", "cnt", "min", "max", "lst", "width")


@query(f"""WITH r AS ({ROLLED_SQL}) SELECT DISTINCT series, 'Day1' AS index, ts1 // {DAY} // 800 AS msp, ts1 // {DAY} % 800 AS lsp, width FROM r
    UNION SELECT DISTINCT series, 'Min10', ts1 // {10 * MIN} // 1008, ts1 // {10 * MIN} % 1008, width FROM r WHERE width <= {MIN * 10}""")
def bin_write_index(spark, d):
    return ingest.write_index(_rolled(spark, d), {"Min10": 10 * MIN, "Day1": DAY})


@query(f"{EV} SELECT event_id, ts_ns // {SEC} // 1200 AS msp, ts_ns // {SEC} % 1200 AS lsp FROM ev")
def partition_address(spark, d):
    assert LAYERS["Sec1"] == (SEC, 1200)
    return ingest.addresses(events(spark, d).withColumnRenamed("ts_ns", "ts1"), "Sec1").select("event_id", "msp", "lsp")


@query(f"{EV} SELECT event_id, min(ts_ns) OVER (PARTITION BY series) // {SEC} AS ts_anchor, (ts_ns - min(ts_ns) OVER (PARTITION BY series) // {SEC} * {SEC}) // 1000000 AS ts_ms, (ts_ns - min(ts_ns) OVER (PARTITION BY series) // {SEC} * {SEC}) % 1000000 AS ts_off_ns FROM ev")
def json_anchor_columns(spark, d):
    return with_offsets(events(spark, d)).select("event_id", "ts_anchor", "ts_ms", "ts_off_ns")


@query(f"""{EV} SELECT event_id, series, printf('%08X', 17 + strlen(series)) || '01' || printf('%016X', ts_ns) || printf('%016X', event_id) || hex(series) || printf('%08X', 17 + strlen(series)) AS frame FROM ev""")
def download_frames(spark, d):
    return events(spark, d).select("event_id", "series", F.hex(download_frame("ts_ns", "event_id", "series")).alias("frame"))


@query(f"""WITH r AS ({ROLLED_SQL}), i AS (SELECT DISTINCT series, ts1 // {DAY} AS day, width, CASE WHEN width < {HOUR} THEN 1 ELSE 2 END AS tier FROM r)
    SELECT series, day, max(width) AS width, arg_max(tier, width) AS tier FROM i WHERE width <= {4 * HOUR} GROUP BY 1, 2""")
def day_source_choice(spark, d):
    tier = F.when(F.col("width") < HOUR, 1).otherwise(2)
    index = _rolled(spark, d).select("series", F.expr(f"ts1 div {DAY}").alias("day"), "width", tier.alias("tier")).distinct()
    return day_sources(index, 4 * HOUR)


# ---------------------------------------------------------------- write path


def _recursive(step: str, where: str) -> str:
    return f"""WITH RECURSIVE ev AS (SELECT event_type AS series, epoch_us(ts) * 1000 AS ts_ns, CAST(round(value * 100) AS BIGINT) AS value, event_id FROM events),
    t AS ((SELECT series, arg_min(event_id, (ts_ns, event_id)) AS event_id, min(ts_ns) AS ts_ns FROM ev GROUP BY 1)
      UNION ALL (SELECT t.series, arg_min(ev.event_id, (ev.ts_ns, ev.event_id)), min(ev.ts_ns) FROM t JOIN ev ON ev.series = t.series AND {where} GROUP BY t.series, t.ts_ns))
    SELECT series, event_id, ts_ns FROM t"""


@query(_recursive("", f"ev.ts_ns >= t.ts_ns + {HOUR}"))
def rate_limit_thinning(spark, d):
    return ingest.thin(events(spark, d), HOUR).select("series", "event_id", "ts_ns")


_LET = f"(t.ts_ns IS NULL OR e.ts_ns >= t.ts_ns + {HOUR} OR e.event_id % 97 = 0)"


@query(f"""WITH RECURSIVE ev AS (SELECT event_type AS series, epoch_us(ts) * 1000 AS ts_ns, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    t AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS ts_ns, false AS took FROM ev
      UNION ALL SELECT e.series, e.n, e.event_id, CASE WHEN {_LET} THEN e.ts_ns ELSE t.ts_ns END, {_LET} FROM t JOIN ev e ON e.series = t.series AND e.n = t.n + 1)
    SELECT series, event_id, ts_ns FROM t WHERE took""")
def forced_writes(spark, d):
    return ingest.thin(events(spark, d), HOUR, forced=F.col("event_id") % 97 == 0).select("series", "event_id", "ts_ns")


def _tier(column: str, quiet: int) -> str:
    return f"(t.{column} IS NULL OR e.ts_ns >= t.{column} + {max(quiet, 1_000_000)})"


_NEW = "(t.ts_ns IS NULL OR (e.ts_ns > t.ts_ns AND e.value <> t.value))"
_TAKES = {"s": f"({_NEW} AND {_tier('s', 0)})", "m": f"({_NEW} AND {_tier('m', 10 * MIN)})", "l": f"({_NEW} AND {_tier('l', HOUR)})"}
_ANY = " OR ".join(_TAKES.values())


@query(f"""WITH RECURSIVE ev AS (SELECT event_type AS series, epoch_us(ts) * 1000 AS ts_ns, CAST(round(value * 100) AS BIGINT) AS value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
    t AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS ts_ns, CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS m, CAST(NULL AS BIGINT) AS l, false AS in_s, false AS in_m, false AS in_l FROM ev
      UNION ALL SELECT e.series, e.n, e.event_id, CASE WHEN {_ANY} THEN e.ts_ns ELSE t.ts_ns END, CASE WHEN {_ANY} THEN e.value ELSE t.value END,
        {", ".join(f"CASE WHEN {c} THEN e.ts_ns ELSE t.{k} END" for k, c in _TAKES.items())}, {", ".join(_TAKES.values())} FROM t JOIN ev e ON e.series = t.series AND e.n = t.n + 1)
    {" UNION ALL ".join(f"SELECT series, ts_ns, value, event_id, '{name}' AS tier FROM t WHERE in_{name[0]}" for name in ("short", "medium", "long"))}""")
def tier_writer(spark, d):
    return ingest.write_tiers(events(spark, d), {"short": 0, "medium": 10 * MIN, "long": HOUR})


@query(f"{EV} SELECT {ROWS} FROM ev WHERE ts_ns >= {END} - {7 * DAY + 7 * DAY // 10}")
def retention_drop(spark, d):
    return ingest.retain(events(spark, d), END, "short")


@query(f"{EV} SELECT {ROWS} FROM ev WHERE NOT (series IN ('click', 'view') AND ts_ns >= {MID} AND ts_ns < {LATE})")
def delete_range(spark, d):
    return ingest.delete_range(events(spark, d), ["click", "view"], MID, LATE)


# ---------------------------------------------------------------- catalog


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')")
def search_channel_regex(spark, d):
    return catalog.search(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), {"p_name": "[aeiou]{2}"})


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)CUSTOMER#0+1')")
def search_channel_icase(spark, d):
    return catalog.search(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name"), {"c_name": "CUSTOMER#0+1"}, ignore_case=True)


@query("SELECT c_name FROM customer WHERE regexp_matches(c_name, '(?i)customer') ORDER BY c_name LIMIT 125")
def search_top125(spark, d):
    return catalog.search_first(spark.read.parquet(f"{d}/customer.parquet").select("c_name"), "c_name", "customer")


@query("SELECT s_name AS name FROM supplier WHERE regexp_matches(s_name, '1') UNION ALL SELECT c_name FROM customer WHERE regexp_matches(c_name, '1')")
def search_union_backends(spark, d):
    a = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"))
    return catalog.search(a, {"name": "1"}).unionByName(catalog.search(b, {"name": "1"}))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def backend_list(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment").distinct()


def _order_configs(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("start"), "o_orderkey", "o_orderstatus")


@query("""WITH o AS (SELECT o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start, o_orderkey, o_orderstatus FROM orders),
    v AS (SELECT *, lead(start) OVER (PARTITION BY o_custkey ORDER BY start, o_orderkey) AS until FROM o),
    l AS (SELECT *, greatest(least(coalesce(until, 10000), 10000) - greatest(start, 9000), 0) AS overlap FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY overlap DESC, start DESC, o_orderkey DESC) AS n FROM l)
    SELECT o_custkey, start, o_orderkey, o_orderstatus, overlap FROM r WHERE n = 1""")
def series_best_match(spark, d):
    return catalog.best_overlap(_order_configs(spark, d), "o_custkey", "start", F.lit(9000).cast("long"), F.lit(10000).cast("long"), "o_orderkey")


@query("SELECT l_suppkey, arg_max((l_returnflag, l_linestatus), (n, -ascii(l_returnflag), -ascii(l_linestatus)))[1] AS l_returnflag, arg_max((l_returnflag, l_linestatus), (n, -ascii(l_returnflag), -ascii(l_linestatus)))[2] AS l_linestatus, max(n) AS votes FROM (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def config_quorum(spark, d):
    return catalog.quorum(spark.read.parquet(f"{d}/lineitem.parquet"), "l_suppkey", ["l_returnflag", "l_linestatus"])


@query("SELECT n.n_nationkey AS ord, n.n_regionkey + n.n_nationkey % 3 AS r_regionkey, r.r_name FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey + n.n_nationkey % 3")
def series_info_left_join(spark, d):
    wanted = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("ord"), (F.col("n_regionkey") + F.col("n_nationkey") % 3).alias("r_regionkey"))
    return catalog.in_order(wanted, spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name"), "r_regionkey")


@query("SELECT DISTINCT p_name, p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1)")
def ambiguous_names(spark, d):
    return catalog.ambiguous(spark.read.parquet(f"{d}/part.parquet").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def latest_per_key(spark, d):
    return catalog.latest(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 15000")
def active_channels(spark, d):
    return catalog.active(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_suppkey"], "l_quantity", 15_000).withColumn("bytes", F.col("bytes").cast("long"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY start DESC, o_orderkey DESC) AS n FROM (SELECT o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start, o_orderkey, o_orderstatus FROM orders)),
    m AS (SELECT o_custkey, o_orderstatus, min(n) AS n FROM k GROUP BY 1, 2)
    SELECT c.c_custkey AS o_custkey, 'O' AS o_orderstatus, CASE WHEN m.n IS NULL THEN 'created' WHEN m.n = 1 THEN 'current' ELSE 'updated' END AS state
    FROM customer c LEFT JOIN m ON m.o_custkey = c.c_custkey AND m.o_orderstatus = 'O'""")
def register_series(spark, d):
    known = _order_configs(spark, d).withColumn("ts", F.struct("start", "o_orderkey")).select("o_custkey", "o_orderstatus", "ts")
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
    return catalog.register(wanted, known, ["o_custkey"], ["o_orderstatus"])


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(s_nationkey, c_nationkey) AS nationkey,
    CASE WHEN c_custkey IS NULL THEN 'new' WHEN s_suppkey IS NULL THEN 'missing' WHEN c_nationkey = s_nationkey THEN 'same' ELSE 'changed' END AS state,
    CASE WHEN c_nationkey <> s_nationkey THEN c_nationkey END AS was
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def catalog_maintain(spark, d):
    known = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nationkey"))
    scanned = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nationkey"))
    return catalog.maintain(known, scanned, ["key"], ["nationkey"]).withColumn("was", F.col("was.nationkey"))


# ---------------------------------------------------------------- usage, pulses, status

USAGE = f"{EV}, a AS (SELECT ts_ns // {10 * MIN} * {10 * MIN} AS snap_ns, series, count(*) AS count, CAST(sum(strlen(series) + 16) AS BIGINT) AS bytes FROM ev GROUP BY 1, 2)"


def _account(spark, d) -> DataFrame:
    return usage.account(events(spark, d), F.octet_length("series") + 16)


@query(f"{USAGE} SELECT * FROM a")
def usage_10min(spark, d):
    return _account(spark, d)


@query(f"{USAGE} SELECT series, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM a GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 3")
def usage_toplist(spark, d):
    return usage.toplist(_account(spark, d), "bytes", 3)


@query(f"{USAGE} SELECT snap_ns, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bytes) AS BIGINT) AS bytes FROM a GROUP BY 1")
def usage_totals(spark, d):
    return usage.totals(_account(spark, d))


@query("SELECT l_partkey, arg_max(d, (n, -d)) AS day, max(n) AS votes FROM (SELECT l_partkey, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) // 30 AS d, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def pulse_vote(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", F.expr("unix_date(cast(l_shipdate as date)) div 30").alias("day"))
    return usage.vote(li, "l_partkey", "day")


@query("""WITH s AS (SELECT l_suppkey, min(l_orderkey) AS lo, min(l_orderkey) + 50 AS hi FROM lineitem GROUP BY 1)
    SELECT o_orderkey, l_suppkey FROM orders JOIN s ON o_orderkey BETWEEN lo AND hi""")
def pulse_interval_lookup(spark, d):
    spans = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("lo")).withColumn("hi", F.col("lo") + 50)
    points = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return usage.in_interval(points, spans, "o_orderkey", "lo", "hi", 64).select("o_orderkey", "l_suppkey")


@query("WITH r AS (SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS n FROM orders) SELECT o_orderkey FROM r WHERE n > 2")
def mark_closed(spark, d):
    return usage.closed(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderdate").select("o_orderkey")


@query("SELECT event_id, CASE WHEN event_id % 13 = 1 THEN 'Connect' ELSE 'Disconnect' END AS status FROM events")
def status_code_map(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", usage.public_status(F.col("event_id") % 13).alias("status"))


@query(f"""{EV}, s AS (SELECT series, ts_ns, event_id, CAST(event_id % 38 AS INTEGER) AS kind FROM ev), b AS (SELECT series, max(ts_ns) AS last FROM s WHERE ts_ns < {MID} GROUP BY 1)
    SELECT s.series, ts_ns, event_id, kind, CASE kind {" ".join(f"WHEN {k} THEN '{v}'" for k, v in usage.STATUS.items())} END AS name, CASE kind WHEN 1 THEN 'Connect' ELSE 'Disconnect' END AS public
    FROM s LEFT JOIN b USING (series) WHERE ts_ns < {LATE} AND (ts_ns >= {MID} OR ts_ns = last)""")
def status_series(spark, d):
    status = events(spark, d, end=LATE).select("series", "ts_ns", "event_id", (F.col("event_id") % 38).cast("int").alias("kind"))
    return usage.status_events(status, MID, LATE)


@query(f"{EV} SELECT event_id, series, min(event_id) OVER (PARTITION BY series) // 10000 * 10000 AS pulse_anchor, event_id - min(event_id) OVER (PARTITION BY series) // 10000 * 10000 AS pulse_off FROM ev")
def pulse_anchor_columns(spark, d):
    return usage.pulse_offsets(events(spark, d), "event_id").select("event_id", "series", "pulse_anchor", "pulse_off")


@query(f"{EV} SELECT event_id, ts_ns // {SEC} AS sec, ts_ns % {SEC} AS ns, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS datetime FROM ev")
def pulse_times(spark, d):
    return events(spark, d).select("event_id", usage.pulse_time(F.col("ts_ns")).alias("t")).select("event_id", "t.*")


_ID = " || chr(31) || ".join(["CAST(o_custkey AS VARCHAR)", "o_orderstatus"])


@query(f"""WITH o AS (SELECT o_custkey, o_orderstatus, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10000000 + o_orderkey AS ts, o_custkey * 10 + ascii(o_orderstatus) AS series FROM orders WHERE o_orderstatus <> 'P'),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC) AS n FROM o),
    h AS (SELECT o_custkey, o_orderstatus, min(n) AS n, CAST(min(series) AS BIGINT) AS series, list_sort(list(DISTINCT ts)) AS tscs FROM k GROUP BY 1, 2),
    w AS (SELECT c_custkey AS o_custkey, unnest(['O', 'P']) AS o_orderstatus FROM customer),
    i AS (SELECT *, list_filter([CAST(CAST('0x' || substr(md5({_ID} || chr(31) || CAST(x AS VARCHAR)), 1, 16) AS UBIGINT) % 9223372036854775807 AS BIGINT) FOR x IN range({catalog.SALTS})], lambda y: y >= {catalog.LEAST_ID})[1] AS fresh FROM w)
    SELECT i.o_custkey, i.o_orderstatus, CASE WHEN h.n IS NULL THEN 'created' WHEN h.n = 1 THEN 'current' ELSE 'updated' END AS state, coalesce(h.series, fresh) AS series,
    CAST(CASE WHEN h.n = 1 THEN len(tscs) ELSE coalesce(len(tscs), 0) + 1 END AS INTEGER) AS times, CASE WHEN h.n = 1 THEN tscs[-1] ELSE 999999999999 END AS newest
    FROM i LEFT JOIN h USING (o_custkey, o_orderstatus)""")
def register_series_ids(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus <> 'P'")
    ts = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 10_000_000 + F.col("o_orderkey")
    known = o.select("o_custkey", "o_orderstatus", ts.alias("ts"), (F.col("o_custkey") * 10 + F.ascii("o_orderstatus")).cast("long").alias("series"))
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(F.lit("O"), F.lit("P"))).alias("o_orderstatus"), F.lit(999_999_999_999).alias("ts"))
    out = catalog.register_ids(wanted, known, ["o_custkey"], ["o_orderstatus"])
    return out.select("o_custkey", "o_orderstatus", "state", "series", F.size("tscs").alias("times"), F.element_at("tscs", -1).alias("newest"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 2, 3, 7)")
def config_by_id(spark, d):
    return catalog.config_of(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", [1, 2, 3, 7])


@query(f"SELECT DISTINCT user_id FROM events WHERE epoch_us(ts) * 1000 // {DAY} IN ({BEG // DAY}, {BEG // DAY + 3}) AND event_type = 'click'")
def active_by_partition(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.expr(f"unix_micros(cast(ts as timestamp)) * 1000 div {DAY}").alias("msp"))
    return catalog.active_in(ev, "user_id", "msp", [BEG // DAY, BEG // DAY + 3], event_type="click")


@query("SELECT 'i32-v01' AS series, i * 500000000 AS ts_ns, CAST(i AS INTEGER) AS value FROM range(200, 320) t(i)")
def generated_series_v01(spark, d):
    return test_series(spark, "i32-v01", 100 * SEC, 160 * SEC)


@query("""SELECT 'f64-wave-v00' AS series, i * 100000000 AS ts_ns, round(list_sum([(cos(-pi() + 2 * pi() / 20 * j) + 1.1) * (sin(i) + 2) FOR j IN range(21)]), 6) AS total FROM range(1000, 1600) t(i)""")
def generated_wave(spark, d):
    wave = test_series(spark, "f64-wave-v00", 100 * SEC, 160 * SEC)
    return wave.select("series", "ts_ns", F.round(to_number(F.col("value"), wave.schema["value"].dataType), 6).alias("total"))
