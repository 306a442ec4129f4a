"""Ingest as streams: stateful thinning, and roll-ups of each micro-batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import accepts


def thin_stream(events: DataFrame, quiet: int, polled: bool = False) -> DataFrame:
    """As :func:`operators.ingest.thin`; the state of a series is its last accepted time.  Late events are rejected."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["ts_ns", "event_id"])
        keep = []
        for ts in rows["ts_ns"]:
            ok = accepts(ts, last, quiet, polled)
            last = int(ts) if ok else last
            keep.append(ok)
        if last is not None:
            state.update((last,))
        yield rows[keep]

    return events.groupBy("series").applyInPandasWithState(step, events.schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    """Count, minimum and maximum by series and window; rows that are later than ``late`` are dropped."""
    stream = events.withWatermark(ts, late)
    return stream.groupBy("series", F.window(ts, width)).agg(F.count("*").alias("cnt"), F.min("value").alias("min"), F.max("value").alias("max"))
