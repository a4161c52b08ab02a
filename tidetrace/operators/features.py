"""Supervised rows from series: scaling, lag columns, lag arrays, alignment."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.functions.scaling import minmax_scale
from tidetrace.plans.layout import SIGNALS, Layout, windowed

# Columns of the experiment files that are not used.
UNUSED_COLUMNS = ("spinning_soll", "spinning_ist", "th_power")


def harmonize_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that only some files carry."""
    return df.drop(*UNUSED_COLUMNS)


def union_samples(frames: Iterable[DataFrame]) -> DataFrame:
    """Append tables by column name; a column missing from one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scale_by_bounds(df: DataFrame, info: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Scale ``{column: range column of info}``. ``info`` has one row; its ranges are read as scalar subqueries."""
    scaled = {}
    for column, bounds in columns.items():
        lo = info.select(F.col(bounds)[0]).scalar()
        hi = info.select(F.col(bounds)[1]).scalar()
        scaled[column] = minmax_scale(F.col(column), lo, hi)
    return df.withColumns(scaled)


def lag_name(column: str, offset: int) -> str:
    if offset == 0:
        return f"{column}_t"
    return f"{column}_t_{'minus' if offset < 0 else 'plus'}_{abs(offset)}"


def lag_features(
    df: DataFrame,
    columns: Iterable[str],
    n_in: int = 1,
    n_out: int = 1,
    layout: Layout = SIGNALS,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Columns ``<name>_t_minus_<n_in>`` … ``<name>_t`` … ``<name>_t_plus_<n_out-1>``; incomplete rows are dropped.

    ``keep`` names further columns that stay as they are.
    """
    columns = list(columns)
    names = [lag_name(c, k) for k in range(-n_in, n_out) for c in columns]

    def shifted(window):
        return {
            lag_name(c, k): F.lag(c, -k).over(window) if k else F.col(c)
            for k in range(-n_in, n_out)
            for c in columns
        }

    rows = windowed(df, layout, shifted, before=n_in, after=n_out - 1)
    return rows.select(*layout.keys, layout.tick, *names, *keep).na.drop(subset=names)


def select_features(df: DataFrame, prefix: str) -> list[str]:
    """Names of the lag columns of one variable, the current value included, oldest first."""
    pattern = re.compile(rf"^{re.escape(prefix)}_t(?:_(minus|plus)_(\d+))?$")
    found = [(m, c) for c in df.columns if (m := pattern.match(c))]
    return [c for m, c in sorted(found, key=lambda mc: {"minus": -1, "plus": 1, None: 0}[mc[0][1]] * int(mc[0][2] or 0))]


def rename_lags(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rename ``var1(t-3)`` to ``<first variable>_t_minus_3`` and so on."""
    names = {}
    for column in df.columns:
        if m := re.fullmatch(r"var(\d+)\(t(?:([+-])(\d+))?\)", column):
            offset = int((m[2] or "") + (m[3] or "0"))
            names[column] = lag_name(variables[int(m[1]) - 1], offset)
    return df.withColumnsRenamed(names)


def lag_array(df: DataFrame, column: str, lag: int, out: str = "features", layout: Layout = SIGNALS) -> DataFrame:
    """The last ``lag`` values up to each row as one array, oldest first. One window whatever the lag.

    As in ``lag_features``, rows without a full history, or with a null or NaN in it, are dropped.
    """

    def history(window):
        return {out: F.collect_list(column).over(window.rowsBetween(-(lag - 1), Window.currentRow))}

    full = F.size(out) == lag
    if dict(df.dtypes)[column] in ("float", "double"):
        full &= ~F.exists(out, lambda v: F.isnan(v))
    return windowed(df, layout, history, before=lag - 1).where(full)


def align_tail(df: DataFrame, lag: int, layout: Layout = SIGNALS) -> DataFrame:
    """Rows that have a full history of ``lag`` rows: those a lag model predicts."""
    rows = windowed(df, layout, lambda w: {"_far": F.lag(layout.tick, lag - 1).over(w)}, before=lag - 1)
    return rows.where(F.col("_far").isNotNull()).drop("_far")


def align_xy(
    df: DataFrame, columns: Iterable[str], target: str, n_in: int, layout: Layout = SIGNALS
) -> DataFrame:
    """Lag columns and the target of the same tick, from one window."""
    return lag_features(df, columns, n_in, 1, layout, keep=[target])


def join_aligned(left: DataFrame, right: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    """Two tables of the same series, joined on (series, tick)."""
    return left.join(right, [*layout.keys, layout.tick])


def persistence_predictions(df: DataFrame, column: str, layout: Layout = SIGNALS) -> DataFrame:
    """The simplest model: the next value is the last one."""
    rows = windowed(df, layout, lambda w: {"y_pred": F.lag(column).over(w)}, before=1)
    return rows.select(*layout.keys, layout.tick, F.col(column).alias("y_true"), "y_pred").na.drop(
        subset=["y_true", "y_pred"]
    )


def forward_diff(df: DataFrame, column: str, out: str = "diff", layout: Layout = SIGNALS) -> DataFrame:
    """``y[t] - y[t+1]``; the last row of each series is dropped."""
    rows = windowed(df, layout, lambda w: {out: F.col(column) - F.lead(column).over(w)}, after=1)
    return rows.na.drop(subset=[out])
