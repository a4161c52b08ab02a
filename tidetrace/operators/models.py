"""Lag models: data-only least squares and its knowledge-guided variant."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.functions.physics import TwoState
from tidetrace.functions.scaling import minmax_inverse
from tidetrace.operators.scores import regression_metrics
from tidetrace.session import scratch_path


def fit_lag_baseline(train: DataFrame, features: list[str], label: str) -> PipelineModel:
    """Least squares on the lag columns: one pass that sums the normal equations."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features"),
            LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction", solver="normal"),
        ]
    ).fit(train)


@dataclass
class LagModel:
    """``sum(weights * features) + intercept``, and the losses of the steps that led there."""

    features: list[str]
    weights: list[float]
    intercept: float
    history: list[dict] = field(default_factory=list)

    def prediction(self) -> Column:
        terms = (F.lit(w) * F.col(c) for w, c in zip(self.weights, self.features))
        return sum(terms, F.lit(self.intercept))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())


def _curvature(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean outer products of ``x`` (with a constant) and of ``dx``: each task adds up its rows, Spark adds up the tasks."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size + 1, size + 1))
        for batch in batches:
            x = np.column_stack([np.vstack(batch["x"].to_numpy()), np.ones(len(batch))])
            total[0] += x.T @ x
            steps = batch["dx"].dropna()
            if len(steps):
                dx = np.vstack(steps.to_numpy())
                total[1][:size, :size] += dx.T @ dx
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = rows.select("x", "dx").mapInPandas(sums, "cell bigint, value double")
    table = cells.groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toPandas()
    gram = table["value"].to_numpy().reshape(2, size + 1, size + 1)
    # The constant's product with itself counts the rows.
    return gram[0] / gram[0][-1, -1], gram[1] / gram[0][-1, -1]


def fit_tgds_linear(
    batches: DataFrame,
    features: list[str],
    label: str,
    rule: TwoState,
    steps: int = 10,
    validation: DataFrame | None = None,
    tolerance: float | None = None,
    patience: int | None = None,
) -> LagModel:
    """Linear lag model for ``mse + theta * min(alpha*static, beta*moving)``, averaged over the rows of all batches.

    Needs ``batch_no`` and ``row_no``, in ``validation`` too. Each step is one aggregation that returns the gradient, scaled by
    a fixed bound on the curvature; the bound makes every step lower the loss or leave it. With theta = 0 the first step is
    least squares. ``history`` has the losses at the start of each step, ``val_`` ones if there is a validation table, and
    ``gradient``, the largest component of the gradient. They come from the same pass.

    With ``tolerance`` the fit ends at a point whose ``gradient`` is no larger; ``steps`` bounds the search. With ``patience``
    it ends after so many steps in a row without a lower loss (the validation loss where there is a table), and the model is
    the point of the lowest one, the earliest on ties; a loss of NaN is never the lowest. Rows are read from the shared folder
    at each step, so that a lost executor costs its tasks only.
    """
    size = len(features)
    window = Window.partitionBy("batch_no").orderBy("row_no")
    x = F.array(*[F.col(c).cast("double") for c in features])
    dx = F.array(*[F.col(c).cast("double") - F.lag(c).over(window) for c in features])
    first = F.lag("row_no").over(window).isNull()

    def steps_of(df: DataFrame, held_out: bool) -> DataFrame:
        return df.select(
            F.lit(held_out).alias("held_out"),
            "batch_no",
            x.alias("x"),
            F.when(~first, dx).alias("dx"),
            F.col(label).cast("double").alias("y"),
        )

    rows = steps_of(batches, False)
    if validation is not None:
        rows = rows.union(steps_of(validation, True))
    path = scratch_path(rows.sparkSession, "steps")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    data, step = _curvature(rows.where("not held_out"), size)
    weight = (1 - rule.theta) if rule.normalized else 1.0
    bound = 2 * weight * data + 2 * rule.theta * max(rule.alpha, rule.beta) * step
    scale = np.linalg.pinv(bound)
    point, history = np.zeros(size + 1), []
    lowest, best, waited = float("inf"), point, 0
    for epoch in range(1, steps + 1):
        found = {r["held_out"]: r for r in _gradient(rows, size, rule, point).collect()}
        row = found[False]
        gradient = np.array([row[f"g_{i}"] for i in range(size + 1)])
        losses = {"epoch": epoch, **{c: row[c] for c in ("loss", "mse", "tgds")}, "gradient": float(np.abs(gradient).max())}
        if validation is not None:
            losses |= {f"val_{c}": found[True][c] if True in found else None for c in ("loss", "mse", "tgds")}
        history.append(losses)
        watched = losses["val_loss"] if losses.get("val_loss") is not None else losses["loss"]
        if watched < lowest:
            lowest, best, waited = watched, point, 0
        else:
            waited += 1
        if tolerance is not None and losses["gradient"] <= tolerance or patience is not None and waited >= patience:
            break
        point = point - scale @ gradient
    if patience is not None:
        point = best
    return LagModel(features, [float(w) for w in point[:-1]], float(point[-1]), history)


def _gradient(rows: DataFrame, size: int, rule: TwoState, point: np.ndarray) -> DataFrame:
    """A row for the training and one for the validation batches: loss at ``point`` and its gradient ``g_0 … g_size``."""
    s, tau = rule.steepness, rule.tolerance
    w, b = [float(v) for v in point[:-1]], float(point[-1])
    predicted = sum((F.lit(w[i]) * F.col("x")[i] for i in range(size)), F.lit(b))
    moved = sum((F.lit(w[i]) * F.col("dx")[i] for i in range(size)), F.lit(0.0))
    d = F.abs(moved)
    zero = F.lit(0.0)
    pull_static = F.greatest(d - tau * s, zero) * F.signum(moved)
    pull_moving = (F.greatest(d - s * (1 + tau), zero) - F.greatest(s * (1 - tau) - d, zero)) * F.signum(moved)
    named = rows.select(
        "held_out",
        "batch_no",
        "dx",
        "x",
        (predicted - F.col("y")).alias("e"),
        rule.static_error(d).alias("static"),
        rule.moving_error(d).alias("moving"),
        pull_static.alias("pull_static"),
        pull_moving.alias("pull_moving"),
    ).withColumn("has_step", F.col("dx").isNotNull())

    aggs = [
        F.count("*").alias("n"),
        F.avg(F.col("e") * F.col("e")).alias("mse"),
        F.coalesce(F.avg(F.when(F.col("has_step"), F.col("static"))), rule.static_error(zero)).alias("static"),
        F.coalesce(F.avg(F.when(F.col("has_step"), F.col("moving"))), rule.moving_error(zero)).alias("moving"),
        F.avg("e").alias("a_b"),
    ]
    for i in range(size):
        aggs += [
            F.avg(F.col("e") * F.col("x")[i]).alias(f"a_{i}"),
            F.coalesce(F.avg(F.col("pull_static") * F.col("dx")[i]), zero).alias(f"s_{i}"),
            F.coalesce(F.avg(F.col("pull_moving") * F.col("dx")[i]), zero).alias(f"t_{i}"),
        ]
    per_batch = named.groupBy("held_out", "batch_no").agg(*aggs)
    static, moving = F.lit(rule.alpha) * F.col("static"), F.lit(rule.beta) * F.col("moving")
    tgds = F.least(static, moving)
    weight = (1 - rule.theta) if rule.normalized else 1.0

    def mean(value: Column) -> Column:
        return F.sum(F.col("n") * value) / F.sum("n")

    out = [mean(rule.combine(F.col("mse"), tgds)).alias("loss"), mean(F.col("mse")).alias("mse"), mean(tgds).alias("tgds")]
    for i in range(size):
        pull = F.when(static <= moving, rule.alpha * F.col(f"s_{i}")).otherwise(rule.beta * F.col(f"t_{i}"))
        out.append(mean(2 * weight * F.col(f"a_{i}") + 2 * rule.theta * pull).alias(f"g_{i}"))
    out.append(mean(2 * weight * F.col("a_b")).alias(f"g_{size}"))
    return per_batch.groupBy("held_out").agg(*out)


def predict_samples(
    model: PipelineModel | LagModel,
    lagged: DataFrame,
    truth: str,
    bounds: tuple[float, float],
    keep: tuple[str, ...] = ("sample_id", "time", "split"),
) -> DataFrame:
    """Predictions of all series at once, in the units of the output. ``truth`` is the scaled target column."""
    lo, hi = (F.lit(float(v)) for v in bounds)
    return model.transform(lagged).select(
        *keep,
        minmax_inverse(F.col(truth), lo, hi).alias("y_true"),
        minmax_inverse(F.col("prediction"), lo, hi).alias("y_pred"),
    )


def score_predictions(predictions: DataFrame, keys: tuple[str, ...] = ("split", "sample_id")) -> DataFrame:
    return regression_metrics(predictions, keys)
