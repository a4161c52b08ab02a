from __future__ import annotations

import pytest
from series_cases import rows_of
from pyspark.sql import functions as F

from tidetrace.functions.scaling import minmax_inverse, minmax_scale, scale_steepness
from tidetrace.operators import features, segments, splits
from tidetrace.operators.consistency import batch_blocks
from tidetrace.plans.layout import Layout

LAYOUTS = [Layout(longest=0), Layout(chunk=4), Layout(chunk=50)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_lag_features(series, layout):
    values, df = series
    got = features.lag_features(df, ["y"], n_in=3, n_out=2, layout=layout)
    names = ["y_t_minus_3", "y_t_minus_2", "y_t_minus_1", "y_t", "y_t_plus_1"]
    assert got.columns == ["sample_id", "time", *names]
    expected = sorted(
        (k, t, *[float(v) for v in vs[t - 3 : t + 2]]) for k, vs in values.items() for t in range(3, len(vs) - 1)
    )
    assert rows_of(got, *got.columns) == expected
    assert features.select_features(got, "y") == names


@pytest.mark.parametrize("layout", LAYOUTS)
def test_lag_array(series, layout):
    values, df = series
    got = features.lag_array(df, "y", 5, layout=layout)
    expected = sorted((k, t, [float(v) for v in vs[t - 4 : t + 1]]) for k, vs in values.items() for t in range(4, len(vs)))
    assert rows_of(got, "sample_id", "time", "features") == expected
    tail = features.align_tail(df, 5, layout)
    assert tail.count() == len(expected)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["var1(t-12)", "var2(t)", "var1(t+1)", "other"])
    got = features.rename_lags(df, ["volt", "power"])
    assert got.columns == ["volt_t_minus_12", "power_t", "volt_t_plus_1", "other"]
    assert features.select_features(got, "volt") == ["volt_t_minus_12", "volt_t_plus_1"]


def test_harmonize(spark):
    a = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0)], "time int, input_voltage double, el_power double, th_power double, spinning_soll double")
    b = a.withColumnRenamed("spinning_soll", "spinning_ist")
    got = features.harmonize_columns(features.union_samples([a, b]))
    assert got.columns == ["time", "input_voltage", "el_power"] and got.count() == 2


def test_scaling(spark):
    df = spark.range(1).select(
        scale_steepness(F.lit(6.388), F.lit(-1.0), F.lit(4000.0)).alias("affine"),
        scale_steepness(F.lit(6.388), F.lit(-1.0), F.lit(4000.0), "linear").alias("linear"),
        minmax_inverse(minmax_scale(F.lit(5000.0), F.lit(-1.0), F.lit(4000.0)), F.lit(-1.0), F.lit(4000.0)).alias("back"),
        minmax_scale(F.lit(3.0), F.lit(2.0), F.lit(2.0)).alias("flat"),
    )
    row = df.first()
    assert row["affine"] == pytest.approx(7.388 / 4001) and row["linear"] == pytest.approx(6.388 / 4001)
    assert row["back"] == pytest.approx(5000.0) and row["flat"] == 1.0


@pytest.mark.parametrize("layout", LAYOUTS)
def test_runs_and_segments(spark, layout):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 5, 5, 7, 9, 9])], "sample_id bigint, time bigint, x int")
    runs = segments.value_runs(df, "x", layout=layout)
    assert [r[1] for r in rows_of(runs, "time", "run_id")] == [1, 1, 1, 2, 3, 3]
    got = segments.static_segments(df, "x", layout)
    assert rows_of(got, "segment", "is_static", "first_tick", "length") == [(1, True, 0, 2), (2, False, 2, 2), (3, True, 4, 1)]
    assert segments.segment_stats(df, "x", layout).first().asDict() == {"max_static_size": 2, "max_lag": 2, "max_length": 6}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_segment_lengths_cover_the_differences(series, layout):
    values, df = series
    got = segments.static_segments(df, "y", layout).groupBy("sample_id").agg(F.sum("length").alias("n"))
    assert rows_of(got, "sample_id", "n") == [(k, len(v) - 1) for k, v in sorted(values.items()) if len(v) > 1]


def test_run_lists_in_parts(series):
    values, df = series
    runs = segments.value_runs(df, "y", layout=Layout(longest=0))
    whole = segments.run_lists(runs, "y", "run_id")
    parts = segments.run_lists(runs, "y", "run_id", part_ticks=2)
    assert parts.agg(F.max(F.size("items"))).first()[0] == 2
    joined = parts.groupBy("sample_id", "run_id", "length").agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "items"))).items).alias("items"))
    assert rows_of(joined, "sample_id", "run_id", "items", "length") == rows_of(whole, "sample_id", "run_id", "items", "length")


def test_a_long_run_has_its_whole_length(spark):
    ticks = spark.range(90_000).selectExpr("1L as sample_id", "id as time", "if(id < 15000, id % 2, if(id < 85000, 5, 6)) as y")
    runs = segments.value_runs(ticks, "y", layout=Layout(longest=0))
    got = segments.run_lists(runs, "y", "run_id").where("items[0] >= 5")
    assert rows_of(got.select("part", "length", F.size("items").alias("n")), "part", "length", "n") == [
        (0, 5_000, 5_000), (0, 70_000, 65_536), (1, 70_000, 4_464)
    ]


GAPS = [(k, t, float(t % 7)) for k, first in ((1, 0), (2, 810)) for t in range(first, first + 60) if t % 4 != 3]


@pytest.mark.parametrize("layout", [Layout(longest=0), Layout(chunk=16), Layout(chunk=5)])
def test_gaps_between_ticks(spark, layout):
    """Look-backs, batches and tails count rows, wherever ticks begin and whatever is missing."""
    df = spark.createDataFrame(GAPS, "sample_id long, time long, y double")
    own = {k: [(t, y) for s, t, y in GAPS if s == k] for k in (1, 2)}
    lagged = features.lag_features(df, ["y"], 4, 1, layout)
    expected = [(k, t, v[i - 4][1], y) for k, v in own.items() for i, (t, y) in enumerate(v) if i >= 4]
    assert rows_of(lagged, "sample_id", "time", "y_t_minus_4", "y_t") == expected
    arrays = features.lag_array(df, "y", 5, layout=layout)
    assert rows_of(arrays.select("sample_id", "time", F.col("features")[0].alias("a"), F.col("features")[4].alias("b")), "sample_id", "time", "a", "b") == expected
    assert rows_of(features.align_tail(df, 5, layout), "sample_id", "time") == [r[:2] for r in expected]
    numbered = [(k, t, i, i // 16) for i, (k, t, _) in enumerate(GAPS)]
    assert rows_of(batch_blocks(df, 16, layout=layout), "sample_id", "time", "row_no", "batch_no") == numbered
    each = [(k, t, i, i // 16) for k, v in own.items() for i, (t, _) in enumerate(v)]
    assert rows_of(batch_blocks(df, 16, "sample", layout), "sample_id", "time", "row_no", "batch_no") == each


def test_nan_drops_the_same_rows_in_both_lag_forms(spark):
    rows = [(1, t, float("nan") if t == 3 else None if t == 8 else float(t)) for t in range(14)]
    df = spark.createDataFrame(rows, "sample_id long, time long, y double")
    layout = Layout(longest=0)
    columns = features.lag_features(df, ["y"], 1, 1, layout)
    assert rows_of(features.lag_array(df, "y", 2, layout=layout), "time") == rows_of(columns, "time") == [
        (t,) for t in range(1, 14) if t not in (3, 4, 8, 9)
    ]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_batches(series, layout):
    values, df = series
    got = batch_blocks(df, 16, layout=layout)
    order = [(k, t) for k in sorted(values) for t in range(len(values[k]))]
    assert rows_of(got, "sample_id", "time", "row_no", "batch_no") == [(k, t, i, i // 16) for i, (k, t) in enumerate(order)]
    own = batch_blocks(df, 16, "sample", layout)
    assert rows_of(own, "sample_id", "time", "row_no", "batch_no") == [(k, t, t, t // 16) for k, t in order]


def test_splits(series, spark):
    _, df = series
    split = splits.split_test(df, [2, 9], pool=[1, 2])
    assert rows_of(split.select("sample_id", "split").distinct(), "sample_id", "split") == [(1, "train"), (2, "test"), (9, "test")]
    marked = splits.split_test(df, spark.createDataFrame([(2,), (9,)], "sample_id bigint"))
    train, test = (marked.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
    assert splits.split_overlap(train, test).count() == 0
    assert rows_of(splits.split_overlap(df, test), "sample_id") == [(2,), (9,)]
    a, b = splits.sample_train(df, 2, 7), splits.sample_train(df, 3, 7)
    assert set(rows_of(a, "sample_id")) < set(rows_of(b, "sample_id"))
    runs = splits.sample_train_runs(df, 3, [7, 8])
    assert rows_of(runs.where("run = 7 and draw_no <= 2"), "sample_id") == rows_of(a, "sample_id")
    tail = splits.tail_split(df, 0.1, layout=Layout(longest=0))
    assert tail.where("split = 'validation'").agg(F.min("row_no"), F.count("*")).first() == (117, 14)
