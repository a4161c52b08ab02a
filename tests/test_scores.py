from __future__ import annotations

import random
import statistics

import numpy as np
import pytest

from tidetrace.operators import experiments, scores
from tidetrace.plans.layout import Layout


def frame(spark, groups):
    rows = [(k, float(y), float(p)) for k, pairs in groups.items() for y, p in pairs]
    return spark.createDataFrame(rows, "sample_id string, y_true double, y_pred double")


def test_metrics(spark):
    draw = np.random.default_rng(2)
    y, p = draw.normal(size=50), draw.normal(size=50)
    groups = {"any": list(zip(y, p)), "exact": [(3, 3), (3, 3)], "flat": [(3, 3), (3, 4)], "zero": [(0, 1)]}
    got = {r["sample_id"]: r for r in scores.regression_metrics(frame(spark, groups)).collect()}
    e = y - p
    expected = {
        "mse": np.mean(e**2), "rmse": np.sqrt(np.mean(e**2)), "mae": np.mean(np.abs(e)), "maxae": np.max(np.abs(e)),
        "r2": 1 - np.sum(e**2) / np.sum((y - y.mean()) ** 2), "mape": np.mean(np.abs(e) / np.abs(y)),
    }
    assert {k: got["any"][k] for k in expected} == pytest.approx(expected)
    assert got["exact"]["r2"] == 1.0 and got["flat"]["r2"] == 0.0
    assert got["zero"]["mape"] == pytest.approx(1 / scores.EPSILON)


@pytest.mark.parametrize("chunk", [5, 1000])
@pytest.mark.parametrize("n", [1, 10, 30, 63])
def test_trimmed(spark, n, chunk):
    draw = random.Random(n)
    values = [draw.choice([0.5, 1.5, 2.25, draw.random() * 100]) for _ in range(n)]
    df = spark.createDataFrame([("test", i, v) for i, v in enumerate(values)], "split string, sample_id bigint, rmse double")
    kept = sorted(values)[round(n * 0.05) : round(n * 0.95)]
    got = scores.trimmed_rmse(df, chunk=chunk).first()
    assert got["rmse_mean"] == pytest.approx(round(statistics.fmean(kept), 3), abs=1e-9)
    assert got["rmse_std"] == pytest.approx(round(statistics.pstdev(kept), 3), abs=1e-9)


@pytest.mark.parametrize("limit", [1, 50])
def test_trimmed_by_bounds_equals_ranking(spark, limit):
    """Groups with nulls, NaN, infinities, ties, one value and far values, by histograms and by ranks."""
    draw = random.Random(limit)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e308, -1e308, 5e-324]
    groups = {
        "a": [draw.gauss(0, 1) for _ in range(300)],
        "b": [draw.choice([1.0, 1.5, 2.0]) for _ in range(120)],
        "c": [7.25] * 60,
        "d": [10.0 ** draw.randint(-300, 6) for _ in range(200)] + [None] * 3,
        "e": [None] * 8 + [draw.random() for _ in range(80)] + [float("nan")] * 4,
        "f": [None] * 90 + [1.0],
        "g": [draw.random() for _ in range(100)] + [float("inf")] * 3 + [float("-inf")] * 3,
        "h": odd[:1] + [2.0],
    }
    rows = [(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "split string, sample_id bigint, rmse double")
    got, expected = (
        {r["split"]: (r["rmse_mean"], r["rmse_std"]) for r in scores.trimmed_rmse(df, chunk=c).collect()} for c in (limit, 1 << 20)
    )
    assert got.keys() == expected.keys() == groups.keys()
    for k in groups:
        assert got[k] == pytest.approx(expected[k], abs=0.0011, nan_ok=True), k


def test_values_at_any_rank(spark):
    """Ranks all over a group of magnitudes from 1e-300 to 1e300, found by dividing bins."""
    draw = random.Random(5)
    values = sorted(draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(500))
    df = spark.createDataFrame([("a", v) for v in values], "split string, _v double")
    ranks = spark.createDataFrame([("a", str(k), k) for k in range(0, 500, 7)], "split string, _side string, _rank bigint")
    got = {int(r["_side"]): (r["_v"], r["_before"], r["_size"]) for r in scores.values_at(df, ("split",), ranks, 3).collect()}
    assert got == {k: (values[k], k, 1) for k in range(0, 500, 7)}


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([("a", 0.0625)], "split string, rmse double")
    assert scores.rmse_summary(df).first()["rmse_mean"] == 0.062


def test_rollup_and_bootstrap(spark):
    draw = random.Random(4)
    rows = [("mse", 1, draw.gauss(5, 1), i) for i in range(400)] + [("two", 1, 2.0, 400), ("two", 1, None, 401)]
    df = spark.createDataFrame(rows, "loss_function string, n_train_samples int, test_rmse_mean double, folder bigint")
    rollup = {r["loss_function"]: r for r in scores.results_rollup(df).collect()}
    assert rollup["two"]["count"] == 1 and rollup["two"]["std"] is None
    assert rollup["mse"]["std"] == pytest.approx(statistics.stdev(r[2] for r in rows[:400]))
    ci = {r["loss_function"]: r for r in scores.bootstrap_ci(df, ("loss_function",), "test_rmse_mean", "folder").collect()}
    mean = statistics.fmean(r[2] for r in rows[:400])
    assert ci["mse"]["mean"] == pytest.approx(mean)
    # One standard error on each side, within sampling noise.
    assert ci["mse"]["ci_high"] - ci["mse"]["ci_low"] == pytest.approx(2 / 400**0.5, rel=0.35)
    assert ci["mse"]["ci_low"] < mean < ci["mse"]["ci_high"]
    assert ci["two"]["ci_low"] == ci["two"]["ci_high"] == 2.0


def test_grid(spark):
    grid = experiments.experiment_grid(spark)
    assert grid.count() == 330 and grid.select("config_id").distinct().count() == 330
    per_name = {r["ex_name"]: r["count"] for r in grid.where("run = 0").groupBy("ex_name").count().collect()}
    assert per_name == {
        "incorrect_prior_knowledge": 15, "approximation_prior_knowledge": 11, "diff_sizes": 24,
        "sensitivity_analysis_lambda": 8, "sensitivity_analysis_tgds_ratio": 8,
    }
    defaults = grid.where("ex_name = 'incorrect_prior_knowledge' and steepness = 6.388 and run = 3").first()
    assert (defaults["theta"], defaults["tgds_ratio"], defaults["loss_tolerance"]) == (1000.0, 0.6, 0.0)


def test_nesting_round_trip(spark):
    rows = [(s, t, float(t * s), float(t - s)) for s, n in ((1, 11), (2, 3)) for t in range(4, 4 + n)]
    df = spark.createDataFrame(rows, "sample_id bigint, time bigint, y_true double, y_pred double")
    nested = experiments.nest_predictions(df, Layout(), part_ticks=5)
    assert nested.count() == 5 and nested.selectExpr("max(size(`true`))").first()[0] == 5
    back = experiments.explode_true_pred(nested)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_long_series_are_nested_in_parts(spark):
    """A series of any length is stored in rows of bounded size, without being asked for; the index has one row for it."""
    df = spark.range(300_000).selectExpr("1L as sample_id", "id as time", "id / 2 as y_true", "id / 4 as y_pred")
    nested = experiments.nest_predictions(df)
    assert nested.selectExpr("max(size(`true`))", "count(*)").first()[:] == (1 << 16, 5)
    index = experiments.nested_series(nested).first()
    assert (index["n"], index["first_tick"], index["parts"]) == (300_000, 0, 5)
    assert experiments.explode_true_pred(nested).exceptAll(df.selectExpr("sample_id", "time", "y_true", "y_pred")).isEmpty()


def test_result_wins_on_shared_columns(spark):
    config = spark.createDataFrame([("a", 1, "c"), ("b", 2, "c"), ("d", 3, "c")], "folder string, seed int, origin string")
    result = spark.createDataFrame([("a", 0.5, "r"), ("b", 0.6, None)], "folder string, rmse double, origin string")
    got = experiments.join_config_result(config, result).select("folder", "seed", "origin", "rmse")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "r", 0.5), ("b", 2, "c", 0.6)]
