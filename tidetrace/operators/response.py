"""Step functions and the expected response of a signal that may only rest or move at a known rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.functions.physics import move_towards, static_curve
from tidetrace.plans.layout import SIGNALS, Layout, next_tick, windowed
from tidetrace.session import settle

PIECE_TICKS = 1 << 16
BLOCK_TICKS = 1 << 8
#: Blocks that take their steps together.
BLOCKS_AT_ONCE = 1 << 10


def change_points(df: DataFrame, column: str, layout: Layout = SIGNALS) -> DataFrame:
    """Ticks at which the value differs from the one before, and the first tick of each series."""
    rows = windowed(df, layout, lambda w: {"_previous": F.lag(column).over(w)}, before=1)
    changed = F.col("_previous").isNull() | (F.col("_previous") != F.col(column))
    return rows.where(changed).select(*layout.keys, layout.tick, column)


def segments_of(points: DataFrame, lengths: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    """Add ``end_tick`` (exclusive) to change points; the last one of a series lasts to its ``length``.

    The lengths are added as closing points rather than joined, so the change points of a series need not meet in one task.
    """
    closing = lengths.select(*layout.keys, F.col("length").cast("bigint").alias(layout.tick), F.lit(True).alias("_closes"))
    both = points.withColumn("_closes", F.lit(False)).unionByName(closing, allowMissingColumns=True)
    return next_tick(both, layout, "end_tick").where(~F.col("_closes")).drop("_closes")


def fill_segments(segments: DataFrame, start: str, value: Column, out: str, layout: Layout = SIGNALS) -> DataFrame:
    """One row per tick of each segment ``[start, end_tick)``.

    Segments are first cut into pieces of ``PIECE_TICKS`` and the pieces are spread over the tasks, so one segment that
    covers most of the table is not written out by one task.
    """
    pieces = (
        segments.where(F.col(start) < F.col("end_tick"))
        .withColumn("_p0", F.floor(F.col(start) / PIECE_TICKS).cast("bigint"))
        .withColumn("_p1", F.floor((F.col("end_tick") - 1) / PIECE_TICKS).cast("bigint"))
        .withColumn("_piece", F.explode(F.sequence("_p0", "_p1")))
        .repartition(*layout.keys, "_piece")
    )
    lo = F.greatest(F.col(start), F.col("_piece") * PIECE_TICKS)
    hi = F.least(F.col("end_tick"), (F.col("_piece") + 1) * PIECE_TICKS) - 1
    ticks = pieces.withColumn("_tick", F.explode(F.sequence(lo, hi)))
    return ticks.select(*layout.keys, F.col("_tick").alias(layout.tick), value.alias(out))


def step_fill(points: DataFrame, lengths: DataFrame, column: str, layout: Layout = SIGNALS) -> DataFrame:
    """Dense series that holds the last value at or before each tick, from change points and series lengths."""
    segments = segments_of(points, lengths, layout)
    return fill_segments(segments.withColumnRenamed(layout.tick, "_start"), "_start", F.col(column), column, layout)


def _knots(targets: np.ndarray, reaches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry levels, sorted, and the levels they lead to, of blocks of steps: a row of ``targets`` and ``reaches`` per block.

    A step takes an entry level to its target, at most by its reach; what a block does is a monotone function of flat and slope-1
    pieces. The entries at which the pieces of a step and all later ones meet are those of the later steps, taken back through
    the step, and the two ends of the step's own flat piece. All blocks take a step at once; a reach of 0 changes nothing.
    """
    blocks, steps = targets.shape
    xs = np.empty((blocks, 2 * steps))
    for j in reversed(range(steps)):
        t, r, later = targets[:, j, None], reaches[:, j, None], xs[:, 2 * j + 2 :]
        later += np.sign(later - t) * r
        xs[:, 2 * j], xs[:, 2 * j + 1] = (t - r)[:, 0], (t + r)[:, 0]
    xs.sort(axis=1)
    ys = xs.copy()
    for j in range(steps):
        t, r = targets[:, j, None], reaches[:, j, None]
        ys = np.maximum(np.minimum(t, ys + r), ys - r)
    return xs, ys


def _bends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points of a function of flat and slope-1 pieces are needed: the ends, and those where flat and sloped pieces meet."""
    flat = np.diff(y) < np.diff(x) / 2
    return np.concatenate([[True], flat[1:] != flat[:-1], [True]])


def _block_starts(blocks: DataFrame, layout: Layout) -> DataFrame:
    """``entry``, the level at which each block of a series is entered.

    ``blocks`` has the ``targets`` and ``reaches`` of a block's steps in lists. Each block is reduced to the bends of its function
    where it lies, all blocks of a batch at once, and the functions of a series are applied one after the other: of a long
    series, one task sees a few numbers per block.
    """
    keys, group = list(layout.keys), (*layout.keys, "_block")

    def reduce_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCKS_AT_ONCE):
                some = batch.iloc[start : start + BLOCKS_AT_ONCE]
                sizes = some["targets"].map(len).to_numpy()
                held = np.arange(sizes.max()) < sizes[:, None]
                targets, reaches = np.zeros(held.shape), np.zeros(held.shape)
                targets[held], reaches[held] = np.concatenate(some["targets"].to_list()), np.concatenate(some["reaches"].to_list())
                functions = [(x[bend], y[bend]) for x, y in zip(*_knots(targets, reaches)) for bend in [_bends(x, y)]]
                yield some[list(group)].assign(
                    opening=targets[:, 0], xs=[x for x, _ in functions], ys=[y for _, y in functions]
                )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, current = 0.0, None
        for batch in batches:
            entries = []
            for name, opening, xs, ys in zip(zip(*[batch[c] for c in keys]), batch["opening"], batch["xs"], batch["ys"]):
                if name != current:
                    level, current = opening, name
                entries.append(level)
                if level <= xs[0]:
                    level = ys[0] - (xs[0] - level)
                elif level >= xs[-1]:
                    level = ys[-1] + (level - xs[-1])
                else:
                    level = float(np.interp(level, xs, ys))
            yield batch[list(group)].assign(entry=entries)

    ids = [blocks.schema[c] for c in group]
    real, reals = T.DoubleType(), T.ArrayType(T.DoubleType())
    reduced = T.StructType([*ids, T.StructField("opening", real), T.StructField("xs", reals), T.StructField("ys", reals)])
    functions = blocks.select(*group, F.col("steps.target").alias("targets"), F.col("steps.reach").alias("reaches"))
    ordered = functions.mapInPandas(reduce_blocks, reduced).repartition(*layout.keys).sortWithinPartitions(*group)
    return ordered.mapInPandas(chain, T.StructType([*ids, T.StructField("entry", real)]))


def expected_levels(
    points: DataFrame, lengths: DataFrame, column: str, steepness: float, layout: Layout = SIGNALS
) -> DataFrame:
    """Per segment of the input: resting output (``target``) and output at its first tick (``start_level``).

    Each segment starts where the one before ended, and the first one rests. Steps are held in blocks of ``BLOCK_TICKS``: the
    level at which each block is entered is found first, then the blocks are walked on their own, whatever a series' length.
    """
    tick = F.col(layout.tick)
    steps = (
        segments_of(points, lengths, layout)
        .withColumn("target", static_curve(F.col(column).cast("double")))
        .withColumn("reach", F.lit(float(steepness)) * (F.col("end_tick") - tick - 1))
        .withColumn("_block", F.floor(tick / min(layout.chunk, BLOCK_TICKS)).cast("bigint"))
    )
    group = [*layout.keys, "_block"]
    step = F.struct(layout.tick, "end_tick", column, "target", "reach")
    blocks = steps.groupBy(*group).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    if layout.split:
        blocks = settle(blocks)
    none = F.array().cast("array<double>")

    def advance(state: Column, step: Column) -> Column:
        level = F.greatest(F.least(step.target, state.level + step.reach), state.level - step.reach)
        return F.struct(level.alias("level"), F.array_append(state.levels, state.level).alias("levels"))

    walked = blocks.join(_block_starts(blocks, layout), group).withColumn(
        "levels", F.aggregate("steps", F.struct(F.col("entry").alias("level"), none.alias("levels")), advance)["levels"]
    )
    walked = walked.select(*layout.keys, F.explode(F.arrays_zip("steps", "levels")).alias("s"))
    names = (layout.tick, "end_tick", column, "target")
    return walked.select(*layout.keys, *[F.col(f"s.steps.{c}").alias(c) for c in names], F.col("s.levels").alias("start_level"))


def expected_response(
    points: DataFrame, lengths: DataFrame, column: str, steepness: float, layout: Layout = SIGNALS
) -> DataFrame:
    """Dense expected output: within a segment the level moves from its start towards the target by ``steepness`` a tick."""
    levels = expected_levels(points, lengths, column, steepness, layout).withColumnRenamed(layout.tick, "_start")
    since = F.lit(float(steepness)) * (F.col("_tick") - F.col("_start"))
    value = move_towards(F.col("start_level"), F.col("target"), since)
    return fill_segments(levels, "_start", value, "expected", layout)
