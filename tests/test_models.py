from __future__ import annotations

import numpy as np
import pytest

from tidetrace.functions.physics import TwoState
from tidetrace.operators import models

FEATURES = ["x1", "x2"]


@pytest.fixture(scope="module")
def batches(spark):
    """A slow walk of inputs and a noisy linear output, in batches of 16 rows and one of a single row."""
    draw = np.random.default_rng(8)
    x = np.cumsum(draw.normal(size=(129, 2)), axis=0) / 10
    y = x @ [0.7, -0.2] + 0.3 + draw.normal(size=129) / 20
    rows = [(i // 16, i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "batch_no bigint, row_no bigint, x1 double, x2 double, y double")
    return x, y, df


def test_without_guidance_it_is_least_squares(batches):
    x, y, df = batches
    fitted = models.fit_tgds_linear(df, FEATURES, "y", TwoState(0.05, 0.1, theta=0.0), steps=2)
    base = models.fit_lag_baseline(df, FEATURES, "y").stages[-1]
    exact, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)
    assert [*fitted.weights, fitted.intercept] == pytest.approx(exact)
    assert [*base.coefficients, base.intercept] == pytest.approx(exact)


@pytest.mark.parametrize("rule", [TwoState(0.05, 0.1, 5.0, 0.6), TwoState(0.3, 0.25, 0.5, 3.0, True), TwoState(0.02, 0.0, 50.0)])
def test_guided_loss_never_rises(batches, rule):
    x, y, df = batches
    fitted = models.fit_tgds_linear(df, FEATURES, "y", rule, steps=6)
    losses = [h["loss"] for h in fitted.history]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0]
    # The first gradient is taken at 0, where the loss is known.
    assert fitted.history[0]["mse"] == pytest.approx(np.mean(y**2))
    # Validated on the training rows themselves, both losses are the same; the fit is not changed by it.
    checked = models.fit_tgds_linear(df, FEATURES, "y", rule, steps=6, validation=df)
    assert checked.weights == pytest.approx(fitted.weights)
    assert [h["val_loss"] for h in checked.history] == pytest.approx(losses)


def test_it_stops_where_the_gradient_is_small(batches):
    _, _, df = batches
    rule = TwoState(0.05, 0.1, theta=0.0)
    fitted = models.fit_tgds_linear(df, FEATURES, "y", rule, steps=9, tolerance=1e-9)
    # the first step of least squares is the last
    assert [h["epoch"] for h in fitted.history] == [1, 2]
    assert fitted.history[0]["gradient"] > 1e-9 >= fitted.history[1]["gradient"]
    plain = models.fit_tgds_linear(df, FEATURES, "y", rule, steps=1)
    assert fitted.weights == plain.weights


def test_patience_keeps_the_best_step(batches):
    """Validated on the outputs turned round, every step away from 0 is worse than the start."""
    from pyspark.sql import functions as F

    _, _, df = batches
    against = df.withColumn("y", -F.col("y"))
    fitted = models.fit_tgds_linear(df, FEATURES, "y", TwoState(0.05, 0.1, 5.0, 0.6), steps=9, validation=against, patience=2)
    assert [h["epoch"] for h in fitted.history] == [1, 2, 3]
    assert [*fitted.weights, fitted.intercept] == [0.0, 0.0, 0.0]
    # a loss that only falls is never waited for
    free = models.fit_tgds_linear(df, FEATURES, "y", TwoState(0.05, 0.1, theta=0.0), steps=2, patience=2)
    assert len(free.history) == 2 and free.history[1]["loss"] < free.history[0]["loss"]


def test_gradient_matches_differences(batches):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    _, _, df = batches
    w = Window.partitionBy("batch_no").orderBy("row_no")
    rows = df.select(
        F.lit(False).alias("held_out"), "batch_no", F.array(*FEATURES).alias("x"), "y",
        F.when(F.lag("row_no").over(w).isNotNull(), F.array(*[F.col(c) - F.lag(c).over(w) for c in FEATURES])).alias("dx"),
    ).cache()
    rule, point, h = TwoState(0.05, 0.1, 5.0, 0.6), np.array([0.4, 0.3, 0.1]), 1e-6
    got = models._gradient(rows, 2, rule, point).first()
    for i in range(3):
        step = np.eye(3)[i] * h
        up, down = (models._gradient(rows, 2, rule, point + s).first()["loss"] for s in (step, -step))
        assert got[f"g_{i}"] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-6)


def test_predictions_are_unscaled(batches, spark):
    _, _, df = batches
    model = models.LagModel(FEATURES, [1.0, 0.0], 0.5)
    got = models.predict_samples(model, df, "y", (-1.0, 3.0), keep=("row_no",)).orderBy("row_no").first()
    first = df.orderBy("row_no").first()
    assert got["y_pred"] == pytest.approx((first["x1"] + 0.5) * 4 - 1) and got["y_true"] == pytest.approx(first["y"] * 4 - 1)
