"""Grids of bins: widths, covering ranges, partition addresses."""

from __future__ import annotations

from dataclasses import dataclass

MS = 1_000_000
SEC = 1000 * MS
MIN, HOUR, DAY = 60 * SEC, 3600 * SEC, 86_400 * SEC

# The ladder of widths for time.
WIDTHS: list[int] = [
    20 * MS, 50 * MS, 100 * MS, 200 * MS, 500 * MS,
    1 * SEC, 2 * SEC, 5 * SEC, 10 * SEC, 20 * SEC,
    1 * MIN, 2 * MIN, 5 * MIN, 10 * MIN, 20 * MIN,
    1 * HOUR, 2 * HOUR, 4 * HOUR, 12 * HOUR,
    1 * DAY, 2 * DAY, 4 * DAY, 8 * DAY, 16 * DAY, 32 * DAY, 64 * DAY,
]

# The ladder of widths for pulses, 10 to 10 million.
PULSE_WIDTHS: list[int] = [m * 10**k for k in range(1, 7) for m in (1, 2, 4, 8)] + [10**7]

# Pre-binned layers, width and bins in a partition.
LAYERS: dict[str, tuple[int, int]] = {
    "Sec1": (SEC, 1200),
    "Sec10": (10 * SEC, 720),
    "Min1": (MIN, 720),
    "Min10": (10 * MIN, 1008),
    "Hour1": (HOUR, 960),
    "Day1": (DAY, 800),
}

DEFAULT_COUNT = 20


@dataclass(frozen=True)
class Grid:
    """Bins ``[first, last)`` of ``width`` ns, counted from the epoch, or of ``width`` pulses, counted from 0."""

    width: int
    first: int
    last: int

    @property
    def beg(self) -> int:
        return self.first * self.width

    @property
    def end(self) -> int:
        return self.last * self.width

    @property
    def count(self) -> int:
        return self.last - self.first

    def edges(self) -> list[int]:
        return [i * self.width for i in range(self.first, self.last + 1)]


def covering(beg: int, end: int, width: int) -> Grid:
    """The bins of a width that cover [beg, end)."""
    if width <= 0 or end < beg:
        raise ValueError("a grid needs a positive width and an ordered range")
    return Grid(width, beg // width, -(-end // width))


def by_count(beg: int, end: int, count: int = DEFAULT_COUNT, widths: list[int] = WIDTHS) -> Grid:
    """At least about ``count`` bins: the largest ladder width that gives them; ``PULSE_WIDTHS`` for ranges of pulses."""
    if not 1 <= count <= 2**31 - 1:
        raise ValueError(f"bin count out of range: {count}")
    most = (end - beg) // count
    if most < 1:
        raise ValueError("the range is shorter than its bins")
    return covering(beg, end, max((w for w in widths if w <= most), default=most))


def nearest_width(wanted: int) -> int:
    """The ladder width for a wanted one; between two, the lower only if the upper is twice as far as wanted or more."""
    wanted = min(max(wanted, WIDTHS[0]), WIDTHS[-1])
    upper = next(w for w in WIDTHS if w >= wanted)
    below = [w for w in WIDTHS if w < upper]
    return below[-1] if below and upper >= 2 * wanted else upper


def by_width(beg: int, end: int, width: int) -> Grid:
    return covering(beg, end, nearest_width(width))


def choose(beg: int, end: int, count: int | None = None, width: int | None = None) -> Grid:
    if count is not None and width is not None:
        raise ValueError("give a bin count or a bin width, not both")
    return by_width(beg, end, width) if width is not None else by_count(beg, end, DEFAULT_COUNT if count is None else count)


def next_finer(width: int, layers: list[int]) -> int | None:
    """The widest layer below ``width``."""
    return max((w for w in layers if w < width), default=None)


def address(ts: int, layer: str) -> tuple[int, int]:
    """Partition and bin within it, of the bin that holds ``ts``."""
    width, length = LAYERS[layer]
    return divmod(ts // width, length)


def address_ts(msp: int, lsp: int, layer: str) -> int:
    width, length = LAYERS[layer]
    return (msp * length + lsp) * width


def cells(beg: int, end: int, layer: str) -> list[tuple[int, int]]:
    """Addresses of the bins that cover [beg, end)."""
    width, length = LAYERS[layer]
    return [divmod(i, length) for i in range(beg // width, -(-end // width))]
