"""Two-state consistency of a signal, by contiguous batches: loss, metric and parameter sweep.

The loss and the metric weigh the two states the opposite way round: the loss takes ``min(alpha*static, beta*moving)``,
the metric ``min(alpha*moving, beta*static)``. That is how the published definitions differ and both are kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.functions.physics import TwoState
from tidetrace.plans.layout import SIGNALS, Layout, with_rows
from tidetrace.session import settle

BATCH_ROWS = 128
ID_BLOCK = 1 << 16


def id_blocks(sizes: DataFrame, key: str) -> DataFrame:
    """``sizes`` with ``_block``: ranges of about ``ID_BLOCK`` ids in order, numbered from 0, for ids of any type that has an order.

    Ranges are between quantiles of a sample that Spark draws, so they hold numbers of ids alike whatever the ids look like. The
    rows are kept with their range in the shared folder: a second sample could draw other ranges.
    """
    kept = settle(sizes)
    blocks = max(1, -(-kept.count() // ID_BLOCK))
    return settle(kept.repartitionByRange(blocks, key).withColumn("_block", F.spark_partition_id()))


def series_offsets(sizes: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    """Per series, what to add to a tick to get the row number over all series in id order.

    ``sizes`` has ``length`` and ``first_tick`` per series, and is computed once. Lengths are summed in blocks of ids, then over
    the blocks' totals, so no task sees all series.
    """
    (key,) = layout.keys
    blocked = id_blocks(sizes, key)
    earlier = Window.partitionBy().orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("_block").agg(F.sum("length").alias("_sum"))
    starts = totals.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.withColumn("_before", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    summed = own.join(starts, "_block")
    offset = (F.col("_start") + F.col("_before") - F.col("first_tick")).cast("bigint")
    return summed.withColumn("offset", offset).drop("_block", "_start", "_before")


def batch_blocks(
    df: DataFrame,
    batch_size: int = BATCH_ROWS,
    boundary: str = "batch",
    layout: Layout = SIGNALS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``row_no`` and ``batch_no``: consecutive blocks of ``batch_size`` rows in (series, tick) order.

    ``boundary="batch"`` runs the blocks across series, as mini-batches of concatenated series do. ``boundary="sample"``
    starts each series on a new block; ``row_no`` is then the tick and ``batch_no`` counts within the series. Where ticks are
    not dense, rows are numbered first and stand for ticks. ``sizes`` (``length`` and ``first_tick`` of each series) saves a
    pass over ``df``.
    """
    columns = df.columns
    if not layout.dense:
        df, layout = with_rows(df, layout)
        sizes = sizes and sizes.withColumn("first_tick", F.lit(0))
    if boundary == "sample":
        row = F.col(layout.tick)
        placed = df
    elif boundary == "batch":
        if sizes is None:
            sizes = df.groupBy(*layout.keys).agg(F.count("*").alias("length"), F.min(layout.tick).alias("first_tick"))
        row = F.col("offset") + F.col(layout.tick)
        placed = _place(df, series_offsets(sizes, layout), layout)
    else:
        raise ValueError(f"boundary must be 'batch' or 'sample', not {boundary!r}")
    return (
        placed.withColumn("row_no", row.cast("bigint"))
        .withColumn("batch_no", F.floor(F.col("row_no") / batch_size).cast("bigint"))
        .select(*columns, "row_no", "batch_no")
    )


def _place(df: DataFrame, offsets: DataFrame, layout: Layout) -> DataFrame:
    """Join the offsets; a long series meets a copy of its offset in each of its chunks."""
    if not layout.split:
        return df.join(offsets.select(*layout.keys, "offset"), [*layout.keys])
    last = F.col("first_tick") + F.col("length") - 1
    chunks = F.sequence(*[F.floor(c / layout.chunk).cast("bigint") for c in (F.col("first_tick"), last)])
    by_chunk = offsets.select(*layout.keys, "offset", F.explode(chunks).alias("_chunk"))
    return df.withColumn("_chunk", layout.chunk_of()).join(by_chunk, [*layout.keys, "_chunk"])


def abs_differences(
    df: DataFrame, column: str = "y_pred", batch: tuple[str, ...] = ("batch_no",), order: str = "row_no"
) -> DataFrame:
    """Add ``d``, the absolute step from the previous row of the batch; NULL on its first row."""
    window = Window.partitionBy(*batch).orderBy(order)
    return df.withColumn("d", F.abs(F.col(column) - F.lag(column).over(window)))


def _over_steps(error: Column, single: Column, combine) -> Column:
    """Aggregate over the steps of a batch. A batch of one row has one step of size 0."""
    return F.when(F.count("*") == 1, single).otherwise(combine(error))


def tgds_loss_by_batch(df: DataFrame, rule: TwoState, batch: tuple[str, ...] = ("batch_no",)) -> DataFrame:
    """Mean squared error plus the two-state penalty, per batch. Needs ``y_true, y_pred`` and ``d``."""
    zero = F.lit(0.0)
    error = F.col("y_true") - F.col("y_pred")
    parts = df.groupBy(*batch).agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        _over_steps(rule.static_error(F.col("d")), rule.static_error(zero), F.avg).alias("static"),
        _over_steps(rule.moving_error(F.col("d")), rule.moving_error(zero), F.avg).alias("trans"),
    )
    tgds = F.least(F.lit(rule.alpha) * F.col("static"), F.lit(rule.beta) * F.col("trans"))
    return parts.withColumn("tgds", tgds).withColumn("loss", rule.combine(F.col("mse"), F.col("tgds")))


def metric_state(
    df: DataFrame, rule: TwoState, batch: tuple[str, ...] = ("batch_no",), keys: tuple[str, ...] = ()
) -> DataFrame:
    """``total`` and ``steps`` of the two-state metric, per ``keys`` (columns of ``batch``) or overall. Needs ``d``.

    States of different batches add up: ``metric_of`` takes the union of any of them.
    """
    zero = F.lit(0.0)
    sums = df.groupBy(*batch).agg(
        F.greatest(F.count("*") - 1, F.lit(1)).alias("steps"),
        _over_steps(rule.moving_error(F.col("d")), rule.moving_error(zero), F.sum).alias("moving"),
        _over_steps(rule.static_error(F.col("d")), rule.static_error(zero), F.sum).alias("still"),
    )
    best = F.least(F.lit(rule.alpha) * F.col("moving"), F.lit(rule.beta) * F.col("still"))
    return sums.groupBy(*keys).agg(F.sum(best).alias("total"), F.sum("steps").alias("steps"))


def metric_of(states: DataFrame, rule: TwoState, keys: tuple[str, ...] = ()) -> DataFrame:
    """The metric of all batches whose states are given. No state at all gives 0, as does a reset one."""
    return (
        states.groupBy(*keys)
        .agg(F.sum("total").alias("total"), F.sum("steps").alias("steps"))
        .select(
            *keys,
            F.coalesce("total", F.lit(0.0)).alias("total"),
            F.coalesce("steps", F.lit(0)).alias("steps"),
            F.coalesce(F.try_divide(F.col("total"), F.col("steps")), F.lit(0.0)).alias("unweighted"),
        )
        .withColumn("loss_tgds", F.col("unweighted") * F.lit(float(rule.theta)))
        .drop("unweighted")
    )


def tgds_metric(
    df: DataFrame, rule: TwoState, batch: tuple[str, ...] = ("batch_no",), keys: tuple[str, ...] = ()
) -> DataFrame:
    """Accumulated two-state metric, per ``keys`` (columns of ``batch``) or overall. Needs ``d``."""
    return metric_of(metric_state(df, rule, batch, keys), rule, keys)


def tgds_sweep(df: DataFrame, rules: Iterable[TwoState], batch: tuple[str, ...] = ("batch_no",)) -> DataFrame:
    """Loss over all batches, weighted by their rows, for many parameter settings from one pass over the steps.

    Only (steepness, tolerance) enter row by row: each distinct pair is two sums of one aggregation, so the rows are not
    multiplied. The other parameters enter per batch, from a table of the given rules. One row out per distinct rule.
    """
    rules = list(dict.fromkeys(rules))
    shapes = list(dict.fromkeys((r.steepness, r.tolerance) for r in rules))
    sums, means = [], []
    for i, shape in enumerate(TwoState(s, t) for s, t in shapes):
        low, high, still = (f"{v!r}D" for v in (*shape.band, shape.still))
        for name, off in (("s", f"greatest(d - {still}, 0D)"), ("m", f"greatest({low} - d, d - {high}, 0D)")):
            sums.append(F.expr(f"sum({off} * {off}) filter (where d is not null)").alias(f"{name}_{i}"))
        # A batch of one row has one step of size 0.
        static_0, moving_0 = (f"{v!r}D" for v in shape.errors_at_rest())
        steps = "greatest(n - 1, 1)"
        means.append(f"{i}, if(n = 1, {static_0}, s_{i} / {steps}), if(n = 1, {moving_0}, m_{i} / {steps})")
    per_batch = df.groupBy(*batch).agg(
        F.count("*").alias("n"), F.expr("avg((y_true - y_pred) * (y_true - y_pred))").alias("mse"), *sums
    )
    by_shape = per_batch.select("n", "mse", F.expr(f"stack({len(shapes)}, {', '.join(means)}) as (shape, static, trans)"))

    values = ", ".join(
        f"({i}, {shapes.index((r.steepness, r.tolerance))}, {r.theta!r}D, {r.ratio!r}D, {r.tolerance!r}D, "
        f"{r.steepness!r}D, {str(r.normalized).lower()}, {r.alpha!r}D, {r.beta!r}D)"
        for i, r in enumerate(rules)
    )
    names = "rule, shape, theta, tgds_ratio, loss_tolerance, steepness_scaled, normalized, alpha, beta"
    table = df.sparkSession.sql(f"select * from values {values} as t({names})")
    keys = ["rule", "theta", "tgds_ratio", "loss_tolerance", "steepness_scaled", "normalized"]
    scored = by_shape.join(F.broadcast(table), "shape").withColumn(
        "tgds", F.least(F.col("alpha") * F.col("static"), F.col("beta") * F.col("trans"))
    )
    weighted = scored.groupBy(*keys).agg(
        F.count("*").alias("batches"),
        (F.sum(F.col("n") * F.col("mse")) / F.sum("n")).alias("mse"),
        (F.sum(F.col("n") * F.col("tgds")) / F.sum("n")).alias("tgds"),
    )
    plain = F.when(F.col("normalized"), 1 - F.col("theta")).otherwise(1.0)
    return weighted.withColumn("loss", plain * F.col("mse") + F.col("theta") * F.col("tgds")).drop("rule")
