"""Runs of equal values and static/slope segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.plans.layout import SIGNALS, Layout, running, windowed

LIST_TICKS = 1 << 16


def value_runs(df: DataFrame, column: str, out: str = "run_id", layout: Layout = SIGNALS) -> DataFrame:
    """Number the maximal runs of equal consecutive values of each series from 1."""
    rows = windowed(df, layout, lambda w: {"_previous": F.lag(column).over(w)}, before=1)
    starts = F.when(F.col("_previous").isNull() | (F.col(column) != F.col("_previous")), 1).otherwise(0)
    return running(rows, layout, {out: ("sum", starts)}).drop("_previous")


def labelled_segments(df: DataFrame, column: str, layout: Layout = SIGNALS) -> DataFrame:
    """Per tick but the last: forward difference, whether it is zero, and the segment it belongs to.

    A segment is a maximal stretch of zero (static) or non-zero (slope) differences, so stretches of different slopes
    that touch are one segment.
    """

    def differences(window):
        return {
            "diff": F.col(column) - F.lead(column).over(window),
            "_previous": F.lag(column).over(window) - F.col(column),
        }

    rows = windowed(df, layout, differences, before=1, after=1).na.drop(subset=["diff"])
    rows = rows.withColumn("is_static", F.col("diff") == 0)
    changed = F.col("_previous").isNull() | (F.col("is_static") != (F.col("_previous") == 0))
    return running(rows, layout, {"segment": ("sum", F.when(changed, 1).otherwise(0))}).drop("_previous")


def static_segments(df: DataFrame, column: str, layout: Layout = SIGNALS) -> DataFrame:
    """One row per segment: label, first tick, number of differences."""
    return (
        labelled_segments(df, column, layout)
        .groupBy(*layout.keys, "segment")
        .agg(
            F.first("is_static").alias("is_static"),
            F.min(layout.tick).alias("first_tick"),
            F.count("*").alias("length"),
        )
    )


def segment_stats(df: DataFrame, column: str, layout: Layout = SIGNALS) -> DataFrame:
    """One row: longest static segment, longest slope (the look-back a lag model needs), longest series."""
    longest = static_segments(df, column, layout).agg(
        F.max(F.when(F.col("is_static"), F.col("length"))).alias("max_static_size"),
        F.max(F.when(~F.col("is_static"), F.col("length"))).alias("max_lag"),
    )
    length = sample_lengths(df, layout).agg(F.max("length").alias("max_length"))
    return longest.select("*", length.scalar().alias("max_length"))


def sample_lengths(df: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    return df.groupBy(*layout.keys).agg(F.count("*").alias("length"))


def run_lists(
    df: DataFrame, column: str, group: str, layout: Layout = SIGNALS, part_ticks: int | None = None
) -> DataFrame:
    """Values of each run or segment as ordered lists, in parts of at most ``part_ticks`` ticks.

    ``part`` counts from the run's own first tick, so a run of up to ``part_ticks`` ticks is one list wherever it lies.
    ``length`` is the number of rows of the whole run.
    """
    part_ticks = part_ticks or LIST_TICKS
    tick = F.col(layout.tick)
    rows = windowed(df, layout, lambda w: {"_previous": F.lag(group).over(w)}, before=1)
    begins = F.when(F.col("_previous").isNull() | (F.col("_previous") != F.col(group)), tick)
    rows = running(rows, layout, {"_first": ("max", begins)})
    part = F.floor((tick - F.col("_first")) / part_ticks).cast("bigint")
    entry = F.struct(tick.alias("t"), F.col(column).alias("v"))
    parts = rows.groupBy(*layout.keys, group, part.alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    run = Window.partitionBy(*layout.keys, group)
    return parts.select(
        *layout.keys,
        group,
        "part",
        F.transform("entries", lambda e: e["v"]).alias("items"),
        F.sum(F.size("entries")).over(run).alias("length"),
    )
