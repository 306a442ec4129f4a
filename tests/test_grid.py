import pytest

from tidemark.plans import grid as g
from tidemark.plans.layers import CacheUsage, source_for


def test_by_count():
    a = g.by_count(72 * g.HOUR, 73 * g.HOUR, 10)
    assert (a.count, a.edges()[0], a.edges()[2]) == (12, 72 * g.HOUR, 72 * g.HOUR + 10 * g.MIN)
    b = g.by_count(20 * g.MIN + 10 * g.SEC, 10 * g.HOUR + 20 * g.MIN + 30 * g.SEC, 10)
    assert (b.count, b.beg, b.end) == (11, 0, 11 * g.HOUR)


def test_pulses():
    assert (len(g.PULSE_WIDTHS), g.PULSE_WIDTHS[:5], g.PULSE_WIDTHS[-2:]) == (25, [10, 20, 40, 80, 100], [8_000_000, 10_000_000])
    a = g.by_count(1_234_567, 1_334_567, 20, g.PULSE_WIDTHS)
    assert (a.width, a.beg, a.end) == (4000, 1_232_000, 1_336_000)


@pytest.mark.parametrize("wanted,width", [(12 * g.SEC, 20 * g.SEC), (25 * g.SEC, 20 * g.SEC), (g.MS, 20 * g.MS), (100 * g.DAY, 64 * g.DAY)])
def test_nearest_width(wanted, width):
    assert g.nearest_width(wanted) == width


def test_bad_requests():
    with pytest.raises(ValueError):
        g.by_count(0, g.HOUR, 0)
    with pytest.raises(ValueError):
        g.choose(0, g.HOUR, 5, g.MIN)


def test_addresses():
    beg = 1_717_751_851 * g.SEC  # 2024-06-07T09:17:31Z
    assert g.cells(beg, beg, "Sec1") == []
    assert g.cells(beg, beg + g.SEC, "Sec1") == [(1431459, 1051)]
    many = g.cells(beg + g.SEC // 10, beg + 268 * g.SEC + g.SEC * 8 // 10, "Sec1")
    assert (len(many), many[0], many[-1]) == (269, (1431459, 1051), (1431460, 119))
    assert g.address_ts(*g.address(beg, "Sec1"), "Sec1") == beg


def test_layers():
    layers = [g.MIN, g.HOUR]
    assert source_for(g.HOUR, layers, CacheUsage.READ).kind == "gapfill"
    assert source_for(g.DAY, layers).layer == g.HOUR
    assert source_for(g.SEC, layers).kind == "events"
    assert source_for(g.SEC, layers, allow_events=False).kind == "empty"
    with pytest.raises(ValueError):
        source_for(90 * g.MIN, layers)
