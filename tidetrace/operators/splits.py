"""Hold-out splits by whole series and by position."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidetrace.operators.consistency import BATCH_ROWS, batch_blocks
from tidetrace.plans.layout import SIGNALS, Layout


def split_test(
    df: DataFrame,
    test_ids: Iterable | DataFrame,
    pool: Iterable | DataFrame | None = None,
    key: str = "sample_id",
    drop_unused: bool = True,
) -> DataFrame:
    """Add ``split``: ``test`` for the given series, ``train`` for the others of the pool (all others by default).

    Series are given as a table with a column ``key``, or as a short list. Series in neither are dropped, or kept with NULL.
    """

    def listed(ids: Iterable | DataFrame, split: str) -> DataFrame:
        if not isinstance(ids, DataFrame):
            ids = df.sparkSession.createDataFrame([(i,) for i in ids], df.select(key).schema)
        return ids.select(key, F.lit(split).alias("split"))

    named = listed(test_ids, "test")
    if pool is not None:
        named = named.union(listed(pool, "train"))
    # "test" comes before "train": a series that is in both is a test series
    named = named.groupBy(key).agg(F.min("split").alias("split"))
    marked = df.join(named, key, "left")
    if pool is None:
        marked = marked.withColumn("split", F.coalesce("split", F.lit("train")))
    marked = marked.select(*df.columns, "split")
    return marked.where(F.col("split").isNotNull()) if drop_unused else marked


def split_overlap(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Series used by both splits: any row is leakage."""
    return left.select(key).distinct().intersect(right.select(key).distinct())


def order_samples(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Distinct series by numeric id."""
    return df.select(F.col(key).cast("bigint").alias(key)).distinct().orderBy(key)


def _draw(seed, key: str):
    return F.md5(F.concat_ws("-", seed.cast("string"), F.col(key).cast("string")))


def sample_train(pool: DataFrame, n: int, seed: int, key: str = "sample_id") -> DataFrame:
    """``n`` series of the pool without replacement. Depends on the seed and the ids only, so settings with equal seeds share it."""
    return pool.select(key).distinct().orderBy(_draw(F.lit(seed), key), key).limit(n)


DRAW_PARTS = 64


def sample_train_runs(pool: DataFrame, n: int, seeds: Iterable[int], key: str = "sample_id") -> DataFrame:
    """``sample_train`` for many seeds at once, with ``draw_no`` from 1; the first k draws are the sample of size k.

    The pool of a run is ranked in ``DRAW_PARTS`` parts first, so that only ``n`` series of each part meet.
    """
    drawn = pool.select(key).distinct().withColumn("run", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = drawn.withColumn("_draw", _draw(F.col("run"), key))
    part = Window.partitionBy("run", F.pmod(F.xxhash64(key), F.lit(DRAW_PARTS))).orderBy("_draw", key)
    first = drawn.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= n)
    order = Window.partitionBy("run").orderBy("_draw", key)
    return first.withColumn("draw_no", F.row_number().over(order)).where(F.col("draw_no") <= n).select(key, "run", "draw_no")


def tail_split(
    df: DataFrame,
    val_frac: float = 0.1,
    batch_size: int = BATCH_ROWS,
    layout: Layout = SIGNALS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: the last ``val_frac`` of the rows in (series, tick) order is ``validation``."""
    rows = batch_blocks(df, batch_size, layout=layout, sizes=sizes)
    total = F.count("*") if sizes is None else F.sum("length")
    first_val = (df if sizes is None else sizes).agg(F.floor(total * (1 - val_frac))).scalar()
    return rows.withColumn("split", F.when(F.col("row_no") < first_val, F.lit("train")).otherwise(F.lit("validation")))
