"""Time-weighted bins from events and from finer bins.

A value holds until the next event.  Every event becomes the segment up to its
successor, cut at the bins' edges; a bin aggregates its pieces.  A carried value
whose successor stands on a bin's edge has no piece there, so that it counts for
neither minimum nor maximum.  Bins before a series' first event don't exist; bins
without an event hold the carried value with count 0.

All of it is built-in functions; only partial sums of (series, bin) are shuffled
after the one shuffle that orders events.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import DAY, Grid, covering
from ..plans.layers import CacheUsage, source_for
from ..sources.scratch import held
from .series import with_next, with_one_before, with_previous


def _spread(segments: DataFrame, width: int) -> DataFrame:
    """Segments (series, ts_ns, value, seg_beg, seg_end) cut at the edges of bins."""
    bins = segments.withColumn("bin", F.explode(F.sequence(F.expr(f"seg_beg div {width}"), F.expr(f"(seg_end - 1) div {width}"))))
    dt = F.least("seg_end", (F.col("bin") + 1) * width) - F.greatest("seg_beg", F.col("bin") * width)
    return bins.withColumn("dt", dt)


def bin_events(events: DataFrame, grid: Grid, zero_count: bool = True, final: bool = True, scale: int = 1, chunk_ns: int = DAY, only: DataFrame | None = None) -> DataFrame:
    """(series, ts1, ts2, cnt, min, max, avg, lst, fnl) of each bin.

    ``events`` have strictly increasing times in a series.  Integer values are
    summed exactly; ``scale`` divides the results.  ``final``: the range is
    complete, so the last value holds to its end; else to the last event.  Of what
    is before the grid only each series' last event is kept.  ``only`` (series, bin):
    the bins that are wanted.
    """
    kind = events.schema["value"].dataType.simpleString()
    exact = kind in ("tinyint", "smallint", "int", "bigint")
    # NaN loses every comparison: minimum and maximum ignore it.
    ev = with_next(with_one_before(events.select("series", "ts_ns", "value"), grid.beg, grid.end), chunk_ns)
    if not final:
        # One row a series: the time of its last event.
        ev = ev.join(ev.groupBy(F.col("series").alias("_s")).agg(F.max("ts_ns").alias("_stop")), F.col("series") == F.col("_s")).drop("_s")
    stop = F.lit(grid.end) if final else F.col("_stop")
    ev = ev.withColumn("seg_beg", F.greatest("ts_ns", F.lit(grid.beg))).withColumn("seg_end", F.least(F.coalesce("next_ns", stop), F.lit(grid.end)))
    pieces = _spread(ev.filter("seg_end > seg_beg"), grid.width)
    if not final:
        # The last event itself has no length yet, but counts.
        alone = ev.filter(F.col("next_ns").isNull() & (F.col("ts_ns") >= grid.beg)).withColumn("bin", F.expr(f"ts_ns div {grid.width}")).withColumn("dt", F.lit(0).cast("long"))
        pieces = pieces.unionByName(alone)
    if only is not None:
        pieces = pieces.join(only, ["series", "bin"], "left_semi")
    own = F.col("ts_ns") >= F.greatest(F.col("bin") * grid.width, F.lit(grid.beg))
    area = F.sum(F.col("value").cast("decimal(20,0)") * F.col("dt").cast("decimal(18,0)")) if exact else F.sum(F.col("value") * F.col("dt"))
    number = F.col("value") if exact else F.when(F.isnan("value"), None).otherwise(F.col("value"))
    out = pieces.groupBy("series", "bin").agg(
        F.sum(own.cast("long")).alias("cnt"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        (area.cast("double") / F.sum("dt")).alias("avg"),
        F.max_by("value", "ts_ns").alias("lst"),
        F.max(F.col("bin") * grid.width + grid.width <= (F.lit(grid.end) if final else F.col("seg_end"))).alias("fnl"),
    )
    if not zero_count:
        out = out.filter("cnt > 0")
    number = lambda c: (F.col(c) / scale).alias(c)
    return out.select("series", (F.col("bin") * grid.width).alias("ts1"), ((F.col("bin") + 1) * grid.width).alias("ts2"), "cnt", *map(number, ("min", "max", "avg", "lst")), "fnl")


def clamp(bins: DataFrame) -> DataFrame:
    """Average within minimum and maximum."""
    return bins.withColumn("avg", F.greatest(F.least("avg", "max"), "min"))


def rebin(bins: DataFrame, width: int, zero_count: bool = False) -> DataFrame:
    """Coarser bins from finer ones, which are mergeable partial aggregates.

    A finer bin that starts inside a coarse bin's span after a hole is preceded by
    the last value before it as a seed of minimum and maximum, unless one starts
    exactly on the edge.  A finer bin that is longer than the coarse ones, or goes
    over their edge, is an error.
    """
    over = F.expr(f"ts1 div {width} <> (ts2 - 1) div {width}")
    bins = bins.withColumn("ts2", F.when(over, F.raise_error(F.lit(f"a bin goes over the edge of bins of {width} ns")).cast("bigint")).otherwise(F.col("ts2")))
    fine = with_previous(bins, ["ts1"], "lst", "_seed", max(DAY, width)).withColumn("bin", F.expr(f"ts1 div {width}"))
    fine = fine.withColumn("_first", F.min("ts1").over(Window.partitionBy("series", "bin")) == F.col("ts1"))
    seeded = F.col("_first") & (F.col("ts1") > F.col("bin") * width)
    seed = F.when(seeded, F.col("_seed"))
    dt = F.col("ts2") - F.col("ts1")
    out = fine.groupBy("series", "bin").agg(
        F.sum("cnt").alias("cnt"),
        F.min(F.least("min", seed)).alias("min"),
        F.max(F.greatest("max", seed)).alias("max"),
        (F.sum(F.col("avg") * dt) / F.sum(dt)).alias("avg"),
        F.max_by("lst", "ts1").alias("lst"),
        F.bool_and("fnl").alias("fnl"),
    )
    if not zero_count:
        out = out.filter("cnt > 0")
    return out.select("series", (F.col("bin") * width).alias("ts1"), ((F.col("bin") + 1) * width).alias("ts2"), "cnt", "min", "max", "avg", "lst", "fnl")


def grid_cells(series: DataFrame, grid: Grid) -> DataFrame:
    """(series, ts1) of every bin of the grid, for each row of ``series``."""
    return series.select("series", F.explode(F.sequence(F.lit(grid.beg), F.lit(grid.end - grid.width), F.lit(grid.width))).alias("ts1"))


def gap_fill(cached: DataFrame, events: DataFrame, grid: Grid, scale: int = 1) -> DataFrame:
    """Cached bins, and those that they lack computed from events: holes first, and of the events' pieces only theirs."""
    stored = cached.filter((F.col("ts1") >= grid.beg) & (F.col("ts1") < grid.end))
    every = grid_cells(events.select("series").distinct(), grid)
    missing = every.join(stored.select("series", "ts1"), ["series", "ts1"], "left_anti").select("series", F.expr(f"ts1 div {grid.width}").alias("bin"))
    return stored.unionByName(bin_events(events, grid, scale=scale, only=missing))


def layered(events: DataFrame, layers: Mapping[int, DataFrame], grid: Grid, cache: CacheUsage = CacheUsage.IGNORE, allow_events: bool = True, scale: int = 1) -> DataFrame:
    """Bins of a grid from the best source: the cached layer of its width, else the next finer one, else events.

    Holes of a layer are filled from events.  Bins that are binned again have
    their average clamped to minimum and maximum.
    """
    source = source_for(grid.width, sorted(layers), cache, allow_events)
    if source.kind == "gapfill":
        return gap_fill(layers[grid.width], events, grid, scale)
    if source.kind == "rebin":
        fine = covering(grid.beg, grid.end, source.layer)
        return clamp(rebin(gap_fill(layers[source.layer], events, fine, scale), grid.width, zero_count=True))
    bins = bin_events(events, grid, scale=scale)
    return bins if source.kind == "events" else bins.limit(0)


def expand(bins: DataFrame, grid: Grid) -> DataFrame:
    """Holes between a series' bins and up to the grid's end filled with the last value, count 0."""
    last = with_previous(bins, ["ts1"], "ts1", "_after", max(DAY, 64 * grid.width), back=False).withColumn("_to", F.coalesce("_after", F.lit(grid.end)))
    at = F.explode(F.when(F.col("_to") > F.col("ts2"), F.sequence(F.col("ts2"), F.col("_to") - grid.width, F.lit(grid.width))))
    holes = last.select("series", at.alias("ts1"), F.col("lst").alias("v"))
    filled = holes.select("series", "ts1", (F.col("ts1") + grid.width).alias("ts2"), F.lit(0).cast("long").alias("cnt"), F.col("v").alias("min"), F.col("v").alias("max"), F.col("v").alias("avg"), F.col("v").alias("lst"), F.lit(True).alias("fnl"))
    return bins.unionByName(filled)


def edge_faults(bins: DataFrame) -> DataFrame:
    """Bins that don't follow their predecessor, whose average is outside by more than 1e-9, or that are empty and not constant."""
    checked = with_previous(bins, ["ts1"], "ts2", "_prev")
    bad = (F.col("_prev") != F.col("ts1")) | ~F.col("avg").between(F.col("min") - 1e-9, F.col("max") + 1e-9) | ((F.col("cnt") == 0) & ((F.col("min") != F.col("lst")) | (F.col("max") != F.col("lst"))))
    return checked.filter(bad).drop("_prev")


def roll_up(events: DataFrame, widths: list[int], beg: int, end: int, scale: int = 1) -> DataFrame:
    """Bins of the first width from events, each further width from the one before, which is written; column ``width`` added."""
    levels = [bin_events(events, Grid(widths[0], beg // widths[0], -(-end // widths[0])), scale=scale)]
    for width in widths[1:]:
        levels[-1] = held(levels[-1], "level")
        levels.append(rebin(levels[-1], width, zero_count=True))
    every = [level.withColumn("width", F.lit(width)) for level, width in zip(levels, widths)]
    return reduce(DataFrame.unionByName, every).filter("cnt > 0 and fnl")
