"""Write path: thinning by rate, tiers, retention, partition addresses and the index of written bins."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import DAY, HOUR, LAYERS, MS, SEC

#: Polled channels may come that much early.
POLL_SLACK = 800 * MS
LEAST_STEP = 1 * MS

# Time to live of each retention tier.
TTL = {"short": 7 * DAY, "medium": 31 * 13 * DAY, "long": 31 * 12 * 17 * DAY}


def event_ttl(tier: str) -> int:
    """Events outlive their tier by a tenth, two days at most."""
    return TTL[tier] + min(TTL[tier] // 10, 2 * DAY)


def accepts(ts: int, last: int | None, quiet: int, polled: bool) -> bool:
    """Whether an event is far enough from the last one that was accepted."""
    if last is None:
        return True
    early = POLL_SLACK if polled else 0
    return ts + early >= last + quiet and ts >= last + LEAST_STEP


def quiet_times(policy: Mapping[str, int | str | None]) -> dict[str, int]:
    """Least time (ns) between events of each tier that archives: "monitor" takes all, a number is seconds, None takes none."""
    return {tier: 0 if how == "monitor" else int(how) * SEC for tier, how in policy.items() if how is not None}


def thin(events: DataFrame, quiet: int, polled: bool = False, forced: Column | None = None) -> DataFrame:
    """Events that a rate limit lets through, in order of time within each series.

    Acceptance depends on what was accepted before, so each series is walked in
    order, by sorted partitions that stream through in batches: no series is held
    in memory.  A null value or repeated time is treated as any other event.
    Events for which ``forced`` is true are let through in any case, and the rate
    counts from them on.
    """

    gap = max(quiet - (POLL_SLACK if polled else 0), LEAST_STEP)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last = None, None
        for batch in batches:
            ts = batch["ts_ns"].to_numpy()
            names = batch["series"].to_numpy()
            must = np.flatnonzero(batch["_tm_forced"].to_numpy())
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(ts)]
            keep = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != series:
                    series, last = names[a], None
                # From one accepted event straight to the next: times are sorted.
                at = a
                while True:
                    free = at if last is None else at + int(np.searchsorted(ts[at:b], last + gap))
                    at = min([free, *must[np.searchsorted(must, at) :][:1]])
                    if at >= b:
                        break
                    keep.append(at)
                    last = int(ts[at])
                    at += 1
            yield batch.drop(columns="_tm_forced").iloc[keep]

    marked = events.withColumn("_tm_forced", F.lit(False) if forced is None else F.coalesce(forced, F.lit(False)))
    ordered = marked.repartition("series").sortWithinPartitions("series", "ts_ns", "event_id")
    return ordered.mapInPandas(walk, events.schema)


def write_tiers(events: DataFrame, quiet: Mapping[str, int], polled: bool = False) -> DataFrame:
    """(series, ts_ns, value, event_id, tier) of each tier that takes an event.

    In order of arrival: an event before or at the last accepted time is dropped,
    so is an unchanged value; then each tier decides by its own rate.
    """
    tiers = list(quiet)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last, last_of = None, None, {}
        for batch in batches:
            rows = []
            for s, ts, value, event_id in zip(batch["series"], batch["ts_ns"], batch["value"], batch["event_id"]):
                if s != series:
                    series, last, last_of = s, None, {}
                if last is not None and (ts <= last[0] or value == last[1]):
                    continue
                took = [t for t in tiers if accepts(ts, last_of.get(t), quiet[t], polled)]
                for t in took:
                    last_of[t] = ts
                    rows.append((s, ts, value, event_id, t))
                if took:
                    last = (ts, value)
            yield pd.DataFrame(rows, columns=["series", "ts_ns", "value", "event_id", "tier"]).astype({"ts_ns": "int64", "event_id": "int64"})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    ordered = events.select("series", "ts_ns", "value", "event_id").repartition("series").sortWithinPartitions("series", "event_id")
    return ordered.mapInPandas(walk, ", ".join(f"{c} {kinds[c]}" for c in ("series", "ts_ns", "value", "event_id")) + ", tier string")


def addresses(bins: DataFrame, layer: str) -> DataFrame:
    """Adds msp and lsp: partition, and bin within it."""
    width, length = LAYERS[layer]
    at = F.expr(f"ts1 div {width}")
    return bins.withColumn("msp", F.expr(f"(ts1 div {width}) div {length}")).withColumn("lsp", at % length)


def write_index(bins: DataFrame, layers: Mapping[str, int]) -> DataFrame:
    """(series, index, msp, lsp, width): which cells of the index layers hold written bins of which width."""
    out = None
    for layer, below in layers.items():
        part = addresses(bins.filter(F.col("width") <= below), layer).select("series", F.lit(layer).alias("index"), "msp", "lsp", "width")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def delete_range(events: DataFrame, series: list[str], beg: int, end: int) -> DataFrame:
    """What is left when a range of some series is deleted."""
    return events.filter(~(F.col("series").isin(series) & (F.col("ts_ns") >= beg) & (F.col("ts_ns") < end)))


def retain(events: DataFrame, now: int, tier: str) -> DataFrame:
    return events.filter(F.col("ts_ns") >= now - event_ttl(tier))


def snapped(grid: int = HOUR):
    """Start of a fixed grid's partition, and the rest."""
    return F.expr(f"ts_ns div {grid}") * grid, F.col("ts_ns") % grid
