"""Error metrics of predictions and summaries of scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.plans.layout import CHUNK_TICKS, Size, measure, ordinals
from tidetrace.session import settle

# Fixed value: smallest divisor of the relative error (double epsilon).
EPSILON = 2.220446049250313e-16
#: Bins of a histogram.
BINS = 1 << 12


def regression_metrics(
    df: DataFrame, keys: tuple[str, ...] = ("sample_id",), truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """MSE, RMSE, R2, MAE, MaxAE and MAPE per group, from one aggregation."""
    y, e = F.col(truth), F.col(truth) - F.col(pred)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count("*")).alias("_sst"),
        F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("maxae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    flat = F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(
        *keys,
        "n",
        "mse",
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("_sst") == 0, flat).otherwise(1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
        "mae",
        "maxae",
        "mape",
    )


def rmse_summary(df: DataFrame, keys: tuple[str, ...] = ("split",), value: str = "rmse") -> DataFrame:
    """Mean and population deviation per group, rounded half-even to 3 places."""
    return df.groupBy(*keys).agg(
        F.bround(F.avg(value), 3).alias(f"{value}_mean"), F.bround(F.stddev_pop(value), 3).alias(f"{value}_std")
    )


def trimmed_rmse(
    df: DataFrame,
    keys: tuple[str, ...] = ("split",),
    value: str = "rmse",
    tie: str = "sample_id",
    trim: float = 0.05,
    size: Size | None = None,
    chunk: int = CHUNK_TICKS,
) -> DataFrame:
    """``rmse_summary`` without the lowest and highest ``trim`` share of each group; bounds rounded half-even.

    NULLs rank lowest and NaN highest. Groups of more than ``chunk`` rows aren't ranked: their bounds come from histograms.
    """
    size = size or measure(df, keys)
    first, end = F.bround(F.col("_n") * trim), F.bround(F.col("_n") * (1 - trim))
    if size.longest > chunk:
        return _trimmed_by_bounds(settle(df.select(*keys, F.col(value).cast("double").alias("_v"))), keys, value, first, end, chunk)
    ranked = ordinals(df, keys, (value, tie), "_rank", size, chunk, group_size="_n")
    return rmse_summary(ranked.where((F.col("_rank") >= first) & (F.col("_rank") < end)), keys, value)


def _holding_rank(counted: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of counted parts of each (keys, side) in ``order``, the one with the row of rank ``_rank``; ``_rank`` becomes that in the part,
    ``_before`` gains the rows before it."""
    earlier = Window.partitionBy(*keys, "_side").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    held = placed.where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size")))
    moved = {"_rank": F.col("_rank") - F.col("_start"), "_before": F.col("_before") + F.col("_start")}
    return held.withColumns(moved).drop("_start")


def values_at(df: DataFrame, keys: tuple[str, ...], ranks: DataFrame, limit: int) -> DataFrame:
    """The values at given ranks of each group: ``ranks`` is (keys, _side, _rank), ranks from 0 in the order of ``_v`` in ``df``, and
    gains ``_v``, ``_before``, the rows with a smaller value, and ``_size``, those with that value.

    A histogram over the range of a group's values tells which of its bins holds the rank, the next one divides that bin. Bins
    are sums that combine before the shuffle; once a bin has at most ``limit`` rows its values are counted. The first bins
    divide magnitudes, later ones a factor of about two evenly, so some six passes tell any two numbers apart.
    """
    v = F.col("_v")
    infinite = F.lit(float("inf"))
    kind = F.when(v.isNull(), 0).when(v == -infinite, 1).when(v < infinite, 2).when(v == infinite, 3).otherwise(4)
    found = ["_rank", "_before", "_low", "_high", "_size"]
    kinds = df.withColumn("_kind", kind).groupBy(*keys, "_kind")
    kinds = kinds.agg(F.count("*").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    held = _holding_rank(kinds.join(ranks, [*keys]).withColumn("_before", F.lit(0).cast("bigint")), keys, "_kind")
    held = settle(held.select(*keys, "_side", *found))
    single = F.col("_low").eqNullSafe(F.col("_high"))
    done = [held.where(single)]
    held = held.where(~single)
    inside = lambda held: df.join(held.drop("_size"), [*keys]).where(v.between(F.col("_low"), F.col("_high")))
    same = [*keys, "_side", "_rank", "_before"]
    # by magnitude at first, then evenly
    place = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 800))
    while not (wide := held.where(F.col("_size") > limit)).isEmpty():
        low, high = place(F.col("_low")), place(F.col("_high"))
        share = F.coalesce(F.try_divide(place(v) - low, high - low), F.lit(0.0))
        bins = inside(wide).withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1))).groupBy(*same, "_bin")
        bins = bins.agg(F.count("*").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        next_held = settle(_holding_rank(bins, keys, "_bin").select(*keys, "_side", *found).union(held.where(F.col("_size") <= limit)))
        done.append(next_held.where(single))
        held = next_held.where(~single)
        # halves, since the width of a range of numbers needn't be one
        place = lambda x: x / 2
    counted = inside(held).groupBy(*same, "_v").agg(F.count("*").alias("_size"))
    last = _holding_rank(counted, keys, "_v").select(*keys, "_side", "_v", "_before", "_size")
    return reduce(DataFrame.union, [d.select(*keys, "_side", F.col("_low").alias("_v"), "_before", "_size") for d in done], last)


def _trimmed_by_bounds(df: DataFrame, keys: tuple[str, ...], value: str, first: Column, end: Column, limit: int) -> DataFrame:
    """The first and last value kept of each group, then the moments of what lies between, with as many copies of the two values as
    are kept."""
    kept = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, first.cast("bigint").alias("_first"), end.cast("bigint").alias("_end"))
    kept = settle(kept.where("_first < _end"))
    sides = F.inline(F.array(F.struct(F.lit("low").alias("_side"), F.col("_first").alias("_rank")), F.struct(F.lit("high").alias("_side"), (F.col("_end") - 1).alias("_rank"))))
    at = settle(values_at(df, keys, kept.select(*keys, sides), limit))
    low = at.where("_side = 'low'").select(*keys, F.col("_v").alias("_low"), (F.col("_before") + F.col("_size")).alias("_upto"))
    high = at.where("_side = 'high'").select(*keys, F.col("_v").alias("_high"), "_before")
    bounds = kept.join(low, [*keys]).join(high, [*keys])
    between = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_v") < F.col("_high"))
    middle = df.join(bounds.select(*keys, "_low", "_high"), [*keys]).where(between).groupBy(*keys)
    middle = middle.agg(F.count("*").alias("n0"), F.avg("_v").alias("m0"), F.stddev_pop("_v").alias("s0"))
    one = F.col("_low").eqNullSafe(F.col("_high"))
    bounds = bounds.join(middle, [*keys], "left").withColumns(
        {
            "n1": F.when(F.col("_low").isNull(), 0).when(one, F.col("_end") - F.col("_first")).otherwise(F.col("_upto") - F.col("_first")),
            "n2": F.when(F.col("_high").isNull() | one, 0).otherwise(F.col("_end") - F.col("_before")),
        }
    )
    # parts of no rows add nothing, whatever their value
    part = lambda n, x: F.when(F.col(n) > 0, F.col(n) * x).otherwise(0.0)
    parts = (("n0", F.col("m0")), ("n1", F.col("_low")), ("n2", F.col("_high")))
    add = lambda terms: reduce(Column.__add__, terms)
    bounds = bounds.withColumn("rows", add(F.coalesce(n, F.lit(0)) for n, _ in parts))
    bounds = bounds.withColumn("mean", F.try_divide(add(part(n, m) for n, m in parts), F.col("rows")))
    off = lambda m: (m - F.col("mean")) * (m - F.col("mean"))
    squares = add([part("n0", F.col("s0") * F.col("s0")), *(part(n, off(m)) for n, m in parts)])
    std = F.sqrt(F.try_divide(squares, F.col("rows")))
    return bounds.select(*keys, F.bround("mean", 3).alias(f"{value}_mean"), F.bround(std, 3).alias(f"{value}_std"))


def results_rollup(
    df: DataFrame, keys: tuple[str, ...] = ("loss_function", "n_train_samples"), value: str = "test_rmse_mean"
) -> DataFrame:
    """Mean, sample deviation and non-null count per group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )


def poisson_cdf() -> list[float]:
    """P(X <= k) of a Poisson variable with mean 1, up to the last k that a draw of 32 bits can tell from the next one."""
    total, out, k = 0.0, [], 0
    while 1 - total > 2.0**-32:
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
        k += 1
    return out


DRAWS_PER_HASH = 4


def hash_draws(seed: int, block: str, row_id: str) -> list[Column]:
    """``DRAWS_PER_HASH`` numbers in [0, 2**32) from the MD5 of ``seed-block-id``; the same in every engine and run."""
    digest = F.expr(f"md5(concat_ws('-', '{seed}', cast({block} as string), cast({row_id} as string)))")
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(DRAWS_PER_HASH)]


def poisson_count(draw: str) -> Column:
    """Poisson(1) count of a 32-bit draw."""
    steps = " ".join(f"when {draw} < {edge * (1 << 32)!r}D then {k}" for k, edge in enumerate(poisson_cdf()))
    return F.expr(f"case {steps} else {len(poisson_cdf())} end")


def bootstrap_ci(
    df: DataFrame,
    keys: tuple[str, ...],
    value: str,
    row_id: str,
    reps: int = 200,
    level: float = 0.68,
    seed: int = 0,
) -> DataFrame:
    """Mean and bootstrap interval of the mean per group.

    Each row draws a Poisson(1) count in each replicate instead of the group drawing rows, so replicates are plain
    weighted sums that combine before the shuffle and no group is brought together. ``reps`` is rounded up to a multiple
    of the draws one hash gives.
    """
    blocks = -(-reps // DRAWS_PER_HASH)
    draws = [f"_u{i}" for i in range(DRAWS_PER_HASH)]
    present = df.where(F.col(value).isNotNull()).select(*keys, value, row_id)
    blocked = present.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hashed = blocked.select(
        *keys, "_block", value, *[u.alias(n) for n, u in zip(draws, hash_draws(seed, "_block", row_id))]
    )
    weighted = hashed.withColumns({n: poisson_count(n) for n in draws})
    sums = weighted.groupBy(*keys, "_block").agg(
        F.array(*[F.try_divide(F.sum(F.col(n) * F.col(value)), F.sum(n)) for n in draws]).alias("_means")
    )
    means = sums.select(*keys, F.explode("_means").alias("rep_mean"))
    tail = (1 - level) / 2
    interval = means.groupBy(*keys).agg(
        F.percentile("rep_mean", F.lit(tail)).alias("ci_low"), F.percentile("rep_mean", F.lit(1 - tail)).alias("ci_high")
    )
    return present.groupBy(*keys).agg(F.avg(value).alias("mean")).join(interval, [*keys])
