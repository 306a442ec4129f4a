"""Limits of responses, and what a response says of itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20
# Events and bytes of a response by default, with large results allowed, and at most; bins, and bytes of a bin.
EVENTS = {"default": (80_000, 8 * MIB), "large": (500_000, 80 * MIB), "most": (4_000_000, 400 * MIB)}
BINS, BIN_BYTES, BYTES_OF_BIN = 10_000, 1_000_000, 400
# Names of the ways to reduce events.
SCHEMES = ("eventBlobs", "fullValue", "timeWeightedScalar", "unweightedScalar", "binnedX", "pulseIdDiff")


@dataclass(frozen=True)
class Limits:
    events: int
    bytes: int


def event_limits(events: int | None = None, size: int | None = None, large: bool = False) -> Limits:
    """What is asked for, up to the most there is; else the default, or that of large results."""
    base, most = EVENTS["large" if large else "default"], EVENTS["most"]
    return Limits(min(base[0] if events is None else events, most[0]), min(base[1] if size is None else size, most[1]))


def bin_limit() -> int:
    return min(BINS, BIN_BYTES // BYTES_OF_BIN)


def scheme(name: str) -> tuple[str, bool]:
    """The projection that a scheme names, and whether bins are weighted by time."""
    if name not in SCHEMES:
        raise ValueError(f"no binning scheme {name!r}")
    return ("fullValue", False) if name == "unweightedScalar" else (name, name in ("timeWeightedScalar", "binnedX"))


def summary(events: DataFrame, kept: DataFrame) -> DataFrame:
    """(series, events, range_final) of a response: ``kept`` of all ``events`` of the range."""
    every = events.groupBy("series").agg(F.count("*").alias("_all"))
    held = kept.groupBy("series").agg(F.count("*").alias("events"))
    return every.join(held, "series", "left").select("series", F.coalesce("events", F.lit(0)).cast("long").alias("events"), (F.coalesce("events", F.lit(0)) == F.col("_all")).alias("range_final"))
