from __future__ import annotations

import random

import pytest

from tidetrace.operators import response
from tidetrace.plans.layout import Layout

LAYOUTS = [Layout(longest=0), Layout(chunk=4), Layout(chunk=60)]


def inputs(spark, seed, longest_hold):
    """Change points of a few input series, as rows and as a table, with their lengths."""
    draw, points, lengths = random.Random(seed), [], []
    for sample, count in ((1, 40), (2, 1), (7, 12)):
        tick, last = 0, None
        for _ in range(count):
            value = draw.choice([v for v in (0.0, 1.0, 2.0, 3.5, 5.0) if v != last])
            points.append((sample, tick, value))
            tick, last = tick + draw.randint(1, longest_hold), value
        lengths.append((sample, tick))
    return (
        points, lengths,
        spark.createDataFrame(points, "sample_id bigint, time bigint, volt double"),
        spark.createDataFrame(lengths, "sample_id bigint, length bigint"),
    )


def by_tick(points, lengths, steepness):
    """Tick by tick: hold the first target, then walk towards each target from where the segment before ended."""
    out, held = [], []
    for sample, length in lengths:
        own = [(t, v) for s, t, v in points if s == sample]
        level = 40 * own[0][1] ** 2
        for i, (start, value) in enumerate(own):
            end = own[i + 1][0] if i + 1 < len(own) else length
            target, begin = 40 * value**2, level
            for tick in range(start, end):
                walk = steepness * (tick - start)
                level = min(target, begin + walk) if target > begin else max(target, begin - walk)
                out.append((sample, tick, level))
                held.append((sample, tick, value))
    return sorted(out), sorted(held)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("seed, hold, steepness", [(1, 9, 200.0), (2, 9, 3.0), (3, 60, 25.0), (4, 2, 1000.0)])
def test_expected_response(spark, layout, seed, hold, steepness):
    points, lengths, df, sizes = inputs(spark, seed, hold)
    got = response.expected_response(df, sizes, "volt", steepness, layout)
    expected, _ = by_tick(points, lengths, steepness)
    rows = sorted((r["sample_id"], r["time"], r["expected"]) for r in got.collect())
    assert [r[:2] for r in rows] == [r[:2] for r in expected]
    assert [r[2] for r in rows] == pytest.approx([r[2] for r in expected])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_step_fill(spark, layout, monkeypatch):
    monkeypatch.setattr(response, "PIECE_TICKS", 16)
    points, lengths, df, sizes = inputs(spark, 5, 50)
    got = response.step_fill(df, sizes, "volt", layout)
    _, held = by_tick(points, lengths, 1.0)
    assert sorted((r["sample_id"], r["time"], r["volt"]) for r in got.collect()) == held
    back = response.change_points(got, "volt", layout)
    assert sorted(tuple(r) for r in back.collect()) == sorted(points)


@pytest.mark.parametrize("steepness", [0.01, 5.0, 400.0])
def test_long_series_in_blocks(spark, steepness):
    """One series of 100,000 change points, from levels that never get near their targets to such that always reach them."""
    draw = random.Random(8)
    points, tick = [], 0
    for i in range(100_000):
        points.append((1, tick, draw.choice([0.0, 1.0, 2.0, 3.5, 5.0]) if i % 1000 else 5.0))
        tick += draw.randint(1, 3)
    df = spark.createDataFrame(points, "sample_id bigint, time bigint, volt double")
    sizes = spark.createDataFrame([(1, tick)], "sample_id bigint, length bigint")
    got = response.expected_levels(df, sizes, "volt", steepness, Layout(chunk=4096)).orderBy("time").collect()
    level, expected = 40 * points[0][2] ** 2, []
    for (_, start, value), end in zip(points, [p[1] for p in points[1:]] + [tick]):
        expected.append(level)
        target, reach = 40 * value**2, steepness * (end - start - 1)
        level = max(min(target, level + reach), level - reach)
    assert [r["start_level"] for r in got] == pytest.approx(expected)
