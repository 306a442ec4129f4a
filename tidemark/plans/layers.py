"""Which layer answers a query: cached bins, finer bins, or events."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import next_finer


class CacheUsage(Enum):
    READ = "read"
    USE = "use"
    IGNORE = "ignore"
    RECREATE = "recreate"
    NO_CACHE = "v0nocache"

    @property
    def reads(self) -> bool:
        return self in (CacheUsage.READ, CacheUsage.USE)

    @property
    def writes(self) -> bool:
        return self in (CacheUsage.USE, CacheUsage.RECREATE)


@dataclass(frozen=True)
class Source:
    """``kind``: "gapfill" (the layer itself, holes from below), "rebin" (a finer layer), "events" or "empty"."""

    kind: str
    layer: int | None = None


def source_for(width: int, layers: list[int], cache: CacheUsage = CacheUsage.IGNORE, allow_events: bool = True) -> Source:
    if cache.reads and width in layers:
        return Source("gapfill", width)
    finer = next_finer(width, layers)
    if finer is not None:
        if width % finer:
            raise ValueError(f"layer {finer} doesn't divide {width}")
        return Source("rebin", finer)
    return Source("events") if allow_events else Source("empty")


def day_sources(index: DataFrame, wanted: int) -> DataFrame:
    """Of each series and day the coarsest width up to ``wanted`` that the index has; of equal ones the tier that keeps longest.

    ``index``: series, day, width, tier (larger keeps longer).
    """
    best = F.max(F.struct("width", "tier")).alias("s")
    return index.filter(F.col("width") <= wanted).groupBy("series", "day").agg(best).select("series", "day", "s.*")
