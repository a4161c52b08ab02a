"""Training histories replayed from their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetrace.plans.layout import Layout, running

EPOCHS = Layout(keys=("run_id",), tick="epoch")
BATCHES = Layout(keys=("run_id", "epoch"), tick="batch")


def best_epoch(history: DataFrame, run: str = "run_id") -> DataFrame:
    """Epoch of the lowest validation loss, the earliest on ties."""
    first = F.min_by("epoch", F.struct("val_loss", "epoch"))
    return history.groupBy(run).agg(first.alias("best_epoch"), F.min("val_loss").alias("best_val_loss"))


def _improvements(history: DataFrame, layout: Layout) -> DataFrame:
    seen = running(history, layout, {"_best": ("min", F.col("val_loss"))}, exclusive=True)
    # NaN sorts above infinity, so a best of NaN counts as none.
    better = F.col("val_loss") < F.least(F.coalesce("_best", F.lit(float("inf"))), F.lit(float("inf")))
    return seen.withColumn("improved", better).drop("_best")


def checkpoint_epochs(history: DataFrame, layout: Layout = EPOCHS) -> DataFrame:
    """Epochs at which a save-best-only checkpoint is written."""
    return _improvements(history, layout).where("improved").select(*layout.keys, layout.tick, "val_loss")


def patience_for(epochs: int) -> int:
    return int(epochs * 0.3)


def early_stop_epoch(history: DataFrame, patience: int, layout: Layout = EPOCHS) -> DataFrame:
    """Per run, the epoch at which training stops after ``patience`` epochs without improvement; NULL if it never does."""
    rows = running(
        _improvements(history, layout),
        layout,
        {"_last": ("max", F.when(F.col("improved"), F.col(layout.tick)))},
    )
    waited = F.col(layout.tick) - F.coalesce("_last", F.lit(0))
    return rows.groupBy(*layout.keys).agg(
        F.min(F.when(waited >= patience, F.col(layout.tick))).alias("stop_epoch"),
        F.max(layout.tick).alias("last_epoch"),
    )


def running_batch_loss(batches: DataFrame, layout: Layout = BATCHES) -> DataFrame:
    """Average loss of the epoch so far, weighted by batch size, as a batch log shows it."""
    rows = running(
        batches, layout, {"_loss": ("sum", F.col("loss") * F.col("n")), "_rows": ("sum", F.col("n"))}
    )
    return rows.withColumn("running_loss", F.col("_loss") / F.col("_rows")).drop("_loss", "_rows")


def first_nan_batch(batches: DataFrame, run: str = "run_id") -> DataFrame:
    """First batch whose loss is NaN or infinite, per run; NULLs if there is none."""
    broken = F.isnan("loss") | (F.abs("loss") == float("inf"))
    first = F.min(F.when(broken, F.struct("epoch", "batch"))).alias("first")
    return batches.groupBy(run).agg(first).select(
        run, F.col("first.epoch").alias("nan_epoch"), F.col("first.batch").alias("nan_batch")
    )
