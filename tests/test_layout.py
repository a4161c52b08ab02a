"""The chunked plans give the rows of the plain windows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidetrace.plans.layout import Layout, Size, measure, next_tick, ordinals, running, windowed

PLAIN = Layout(longest=0)


def chunked(size):
    return Layout(chunk=size)


def sorted_rows(df):
    return sorted(df.collect(), key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("chunk", [1, 5, 16, 1000])
@pytest.mark.parametrize("reach", [(1, 0), (0, 1), (3, 2), (12, 0)])
def test_windowed(series, chunk, reach):
    _, df = series
    before, after = reach

    def columns(w):
        out = {f"b{k}": F.lag("y", k).over(w) for k in range(1, before + 1)}
        return out | {f"a{k}": F.lead("y", k).over(w) for k in range(1, after + 1)}

    expected = windowed(df, PLAIN, columns, before, after)
    assert sorted_rows(windowed(df, chunked(chunk), columns, before, after)) == sorted_rows(expected)


@pytest.mark.parametrize("chunk", [1, 5, 16, 1000])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(series, chunk, exclusive):
    _, df = series
    some = F.when(F.col("y") > 0, F.col("y") * F.col("time"))
    columns = {kind: (kind, some) for kind in ("sum", "min", "max", "last")}
    expected = running(df, PLAIN, columns, exclusive)
    assert sorted_rows(running(df, chunked(chunk), columns, exclusive)) == sorted_rows(expected)


@pytest.mark.parametrize("chunk", [1, 5, 16])
def test_next_tick_with_gaps(series, chunk):
    _, df = series
    sparse = df.where("y = 1")
    assert sorted_rows(next_tick(sparse, chunked(chunk))) == sorted_rows(next_tick(sparse, PLAIN))


def crowded(spark):
    """Group 1 is large: most of it in one second long after its first row, half of that at the same instant."""
    start, draw = datetime(2024, 1, 1), random.Random(3)
    rows = [(1, start, 0)]
    rows += [(1, start + timedelta(days=900, microseconds=draw.randint(0, 1000000)), i) for i in range(1, 200)]
    rows += [(1, start + timedelta(days=901), i) for i in range(200, 400)]
    rows += [(2, start + timedelta(hours=i), 1000 + i) for i in range(30)]
    rows += [(3, None, 2000), (3, start, 2001)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, ts timestamp, id bigint")


def test_ordinals(spark):
    df = crowded(spark)
    expected = ordinals(df, ("k",), ("ts", "id"), "n")
    assert measure(df, ("k",)) == Size(400, 432, 3)
    for chunk in (10, 50, 399):
        assert sorted_rows(ordinals(df, ("k",), ("ts", "id"), "n", chunk=chunk)) == sorted_rows(expected)


def test_ordinals_of_awkward_values(spark):
    """NULL, NaN, infinities and integers beyond double precision keep their sort order."""
    values = [None, float("nan"), float("inf"), float("-inf"), 1e-300, 0.0, *range(20)]
    rows = [(1, None if v is None else float(v), i) for v in values for i in range(5)]
    df = spark.createDataFrame(rows, "k bigint, v double, id bigint")
    assert sorted_rows(ordinals(df, ("k",), ("v", "id"), "n", chunk=6).select("n", "id")) == sorted_rows(
        ordinals(df, ("k",), ("v", "id"), "n").select("n", "id")
    )
    wide = spark.createDataFrame([(1, 2**62 + i % 7, -i) for i in range(60)], "k bigint, v bigint, id bigint")
    assert sorted_rows(ordinals(wide, ("k",), ("v", "id"), "n", chunk=6)) == sorted_rows(ordinals(wide, ("k",), ("v", "id"), "n"))


def test_ordinals_cut_a_crowded_group(spark):
    """No window of the cut plan sees more than a few chunks of the large group."""
    from tidetrace.plans.layout import _cut

    df, keys = crowded(spark), ("k",)
    for level in range(3):
        df = _cut(df, keys, ("ts", "id"), f"_r{level}", 25)
        keys = (*keys, f"_r{level}")
    assert df.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 50


def test_whole_table_as_one_group(series):
    _, df = series
    by_id = Layout(keys=(), tick="sample_id", chunk=2)
    sizes = df.groupBy("sample_id").agg(F.count("*").alias("n"))
    got = running(sizes, by_id, {"before": ("sum", F.col("n"))}, exclusive=True)
    assert sorted_rows(got.select("sample_id", "before")) == [(1, None), (2, 120), (3, 127), (9, 128)]


@pytest.mark.parametrize("cast", ["date_add(date'2020-01-01', cast(n as int))", "concat('id-', lpad(n, 5, '0'))", "cast(n as decimal(12, 2))"])
def test_ordinals_by_other_types(spark, cast):
    """A large group is cut into ranges whatever the type of its order column."""
    df = spark.range(300).selectExpr("1L as k", "(id * 7919) % 300 as n").selectExpr("k", "n", f"{cast} as o")
    got = ordinals(df, ("k",), ("o", "n"), "place", chunk=16)
    assert [r.place for r in got.orderBy("n").collect()] == list(range(300))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text or "_r0" in text


def test_texts_with_a_shared_beginning(spark):
    """Times as texts, all of one day: ranges are of what comes after the day."""
    from tidetrace.plans.layout import _cut

    df = spark.range(1000).selectExpr("1L as k", "cast(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id, 0) as string) as o", "id")
    df = df.unionByName(spark.createDataFrame([(1, None, 5000), (2, "x", 5001)], "k long, o string, id long"))
    cut = _cut(_cut(df, ("k",), ("o",), "a", 100), ("k", "a"), ("o",), "b", 100)
    assert cut.groupBy("k", "a", "b").count().agg(F.max("count")).first()[0] <= 100
    got = ordinals(df, ("k",), ("o", "id"), "n", chunk=100)
    assert sorted_rows(got) == sorted_rows(ordinals(df, ("k",), ("o", "id"), "n"))
    same = spark.range(300).selectExpr("1L as k", "'same' as o", "encode(lpad(cast(id as string), 4, '0'), 'utf-8') as id")
    assert sorted(r.n for r in ordinals(same, ("k",), ("o", "id"), "n", chunk=50).collect()) == list(range(300))
