"""Experiment settings, results and nested predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetrace.functions.physics import TwoState
from tidetrace.functions.scaling import scale_steepness
from tidetrace.plans.layout import SIGNALS, Layout

#: Ticks of a row of nested predictions, for series that may not fit in one.
PART_TICKS = 1 << 16
# Fixed values of the published experiment grid.
STEEPNESS = 6.388
RUNS = 5
THETAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
RATIOS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
TRAIN_SIZES = (1, 2, 3, 4, 5, 6)
SIZE_TOLERANCES = (0.0, 0.01, 0.1)
WRONG_FACTORS = tuple(2.0**k for k in range(-7, 8))
TOLERANCES = tuple(k / 20 for k in range(11))
DEFAULTS = {"theta": 1000.0, "tgds_ratio": 0.6, "loss_tolerance": 0.0, "steepness": STEEPNESS}
PLAIN_LOSS = "mean_squared_error"
TWO_STATE_LOSS = "soft_weighted_two_state"

def grid_settings() -> list[dict]:
    """The settings of one run; keys left out take the defaults."""

    def setting(ex_name: str, train_size: int = 4, loss: str = TWO_STATE_LOSS, **given: float) -> dict:
        return {"ex_name": ex_name, "train_size": train_size, "loss": loss, **DEFAULTS, **given}

    wrong = [setting("incorrect_prior_knowledge", steepness=STEEPNESS * f) for f in WRONG_FACTORS]
    loose = [setting("approximation_prior_knowledge", loss_tolerance=t) for t in TOLERANCES]
    sizes = [
        row
        for size in TRAIN_SIZES
        for row in (
            *[setting("diff_sizes", size, loss_tolerance=t) for t in SIZE_TOLERANCES],
            setting("diff_sizes", size, PLAIN_LOSS),
        )
    ]
    theta = [setting("sensitivity_analysis_lambda", theta=t, tgds_ratio=1.0) for t in THETAS]
    ratio = [setting("sensitivity_analysis_tgds_ratio", tgds_ratio=r) for r in RATIOS]
    return [*wrong, *loose, *sizes, *theta, *ratio]


def experiment_grid(spark: SparkSession) -> DataFrame:
    """All settings of all runs: 330 rows."""
    settings = grid_settings()
    rows = ", ".join(
        f"({i}, '{r['ex_name']}', {r['train_size']}, '{r['loss']}', {r['theta']!r}D, {r['tgds_ratio']!r}D, "
        f"{r['loss_tolerance']!r}D, {r['steepness']!r}D)"
        for i, r in enumerate(settings)
    )
    names = "setting_no, ex_name, train_size, loss, theta, tgds_ratio, loss_tolerance, steepness"
    table = spark.sql(f"select * from values {rows} as t({names})")
    runs = table.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    return runs.withColumn("config_id", F.col("run") * len(settings) + F.col("setting_no"))


def grid_rules(lo: float, hi: float, mode: str = "affine") -> list[TwoState]:
    """The two-state rule of each setting of a run, for outputs scaled by [lo, hi]."""
    span = (hi - lo) or 1.0
    offset = lo if mode == "affine" else 0.0
    return [
        TwoState(
            steepness=(row["steepness"] - offset) / span,
            tolerance=row["loss_tolerance"],
            theta=row["theta"] if row["loss"] == TWO_STATE_LOSS else 0.0,
            ratio=row["tgds_ratio"],
        )
        for row in grid_settings()
    ]


def with_rule_columns(grid: DataFrame, lo: float, hi: float, mode: str = "affine") -> DataFrame:
    """Add the columns that identify a setting's rule in a sweep: ``rule_theta`` and ``steepness_scaled``."""
    theta = F.when(F.col("loss") == TWO_STATE_LOSS, F.col("theta")).otherwise(0.0)
    scaled = scale_steepness(F.col("steepness"), F.lit(lo), F.lit(hi), mode)
    return grid.withColumns({"rule_theta": theta, "steepness_scaled": scaled})


def join_config_result(config: DataFrame, result: DataFrame, key: str = "folder") -> DataFrame:
    """One row per folder that has both; the result's value wins where both have a column."""
    shared = [c for c in config.columns if c in result.columns and c != key]
    both = config.alias("c").join(result.alias("r"), key)
    return both.select(
        key,
        *[F.coalesce(f"r.{c}", f"c.{c}").alias(c) for c in shared],
        *[F.col(f"c.{c}") for c in config.columns if c != key and c not in shared],
        *[F.col(f"r.{c}") for c in result.columns if c != key and c not in shared],
    )


def project_results(df: DataFrame) -> DataFrame:
    return df.select("loss_function", "n_train_samples", "test_rmse_mean", "folder")


def nest_predictions(df: DataFrame, layout: Layout = SIGNALS, part_ticks: int | None = None) -> DataFrame:
    """Ordered ``true`` and ``pred`` lists, one row per series, or per part of one.

    ``part`` counts the parts, ranges of ``part_ticks`` ticks. Series known to fit in a chunk are whole by default; others come
    in parts of ``PART_TICKS``, so that no task or row ever holds a series. ``nested_series`` lists the parts of each.
    """
    if part_ticks is None and layout.split:
        part_ticks = min(layout.chunk, PART_TICKS)
    entry = F.struct(layout.tick, "y_true", "y_pred")
    part = F.floor(F.col(layout.tick) / part_ticks).cast("bigint") if part_ticks else F.lit(0).cast("bigint")
    return (
        df.groupBy(*layout.keys, part.alias("part"))
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select(
            *layout.keys,
            "part",
            F.col(f"e.{layout.tick}")[0].alias(layout.tick),
            F.col("e.y_true").alias("true"),
            F.col("e.y_pred").alias("pred"),
        )
    )


def nested_series(nested: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    """One row per series of nested predictions: ``n`` rows, ``first_tick``, and ``parts``, the number of rows it is stored in. The
    lists themselves aren't read, only their sizes."""
    return nested.groupBy(*layout.keys).agg(
        F.sum(F.size("true")).alias("n"), F.min(layout.tick).alias("first_tick"), F.count("*").alias("parts")
    )


def explode_true_pred(df: DataFrame, layout: Layout = SIGNALS) -> DataFrame:
    """Nested predictions back to one row per tick. Ticks of a part are consecutive from its first."""
    rows = df.select(*layout.keys, layout.tick, F.posexplode(F.arrays_zip("true", "pred")).alias("i", "z"))
    return rows.select(
        *layout.keys,
        (F.col(layout.tick) + F.col("i")).cast("bigint").alias(layout.tick),
        F.col("z.true").alias("y_true"),
        F.col("z.pred").alias("y_pred"),
    )
