"""The registered queries: each reads the given tables and uses the library as a caller would."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetrace.functions import physics, scaling, text
from tidetrace.functions.physics import TwoState
from tidetrace.operators import consistency, experiments, features, history, models, response, scores, segments, splits
from tidetrace.plans import views
from tidetrace.plans.layout import Size
from tidetrace.session import scratch_path, settle
from tidetrace.sources import results as result_files
from tidetrace.sources import signals as files
from tidetrace.streaming import consistency as live

Query = Callable[[SparkSession, str], DataFrame]

# Settings shared with the SQL checks.
LAG = 4
RULE = TwoState(steepness=0.07, tolerance=0.1, theta=2.0, ratio=0.6)
NORMALIZED_RULE = TwoState(steepness=0.2, tolerance=0.25, theta=0.4, ratio=3.0, normalized=True)
METRIC_RULE = TwoState(steepness=0.07, tolerance=0.0, theta=1000.0, ratio=0.6)
STREAM_RULE = TwoState(steepness=20.0, tolerance=0.1, theta=1.0, ratio=0.6)
STREAM_SLICE, STREAM_WINDOW = "6 hours", "1 day"
RESPONSE_STEEPNESS = 30.0
PATIENCE = history.patience_for(50)
REPS, LEVEL = 200, 0.68
SEEDS = tuple(range(experiments.RUNS))
VAL_FRAC = 0.1
FIT_STEPS = 6
GUIDED_RULE = TwoState(steepness=0.05, tolerance=0.1, theta=3.0, ratio=0.6)

# Nine significant digits of a number that isn't negative, in any SQL.
SIGNIFICANT = (
    "case when {0} = 0 then {0} when {0} < 1e9 then round({0} * pow(10, 8 - floor(log10({0})))) / pow(10, 8 - floor(log10({0}))) "
    "else round({0} / pow(10, floor(log10({0})) - 8)) * pow(10, floor(log10({0})) - 8) end"
)

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def as_text(items: str | Column) -> Column:
    return F.array_join(F.transform(items, lambda v: v.cast("bigint").cast("string")), ",")


# ---- files -------------------------------------------------------------------------------------------------------

SIGNAL_COLUMNS = "time BIGINT, input_voltage DOUBLE, el_power DOUBLE"


def _signal_files(spark: SparkSession, sf_dir: str, series_per_folder: int) -> str:
    rows, layout = views.signals(spark, sf_dir)
    path = scratch_path(spark, "signals")
    files.write_signals(
        rows.select("sample_id", "time", "input_voltage", "el_power"), path,
        series_per_folder=series_per_folder, layout=layout,
    )
    return path


@query
def scan_signals(spark, sf_dir):
    return files.read_signals(spark, _signal_files(spark, sf_dir, 1000), "sample_id BIGINT, " + SIGNAL_COLUMNS)


@query
def sample_id_from_path(spark, sf_dir):
    rows = files.read_signals(spark, _signal_files(spark, sf_dir, 1), SIGNAL_COLUMNS)
    return rows.groupBy("sample_id").agg(F.count("*").alias("n")).orderBy("sample_id")


@query
def harmonize_columns(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    rows = rows.select("sample_id", "time", "input_voltage", "el_power", F.lit(0.0).alias("th_power"))
    odd, path = F.col("sample_id") % 2 == 1, scratch_path(spark, "experiments")
    variants = {
        "a": rows.where(odd).withColumn("spinning_soll", F.col("input_voltage")),
        "b": rows.where(~odd).select("el_power", F.col("el_power").alias("spinning_ist"), "th_power", "time", "input_voltage", "sample_id"),
    }
    for folder, variant in variants.items():
        files.write_table(variant, f"{path}/{folder}", sep="|")
    found = files.read_by_header(spark, path, "sample_id BIGINT, " + SIGNAL_COLUMNS + ", th_power DOUBLE", glob="*.csv")
    return features.harmonize_columns(found)


@query
def read_info(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    stats = segments.segment_stats(rows, "el_power", layout)
    bounds = views.info(spark)
    path = scratch_path(spark, "info")
    files.write_info(
        stats.select(
            bounds.select("input_range").scalar().alias("input_range"),
            bounds.select("output_range").scalar().alias("output_range"),
            "*",
        ),
        path,
    )
    return files.read_info(spark, path).select(
        F.col("input_range")[0].alias("input_lo"),
        F.col("input_range")[1].alias("input_hi"),
        F.col("output_range")[0].alias("output_lo"),
        F.col("output_range")[1].alias("output_hi"),
        "max_static_size",
        "max_lag",
        "max_length",
    )


@query
def write_signals(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    path = scratch_path(spark, "table")
    columns = "sample_id BIGINT, " + SIGNAL_COLUMNS
    files.write_table(rows.select("sample_id", "time", "input_voltage", "el_power"), path)
    return files.read_table(spark, path, columns)


def _stored_predictions(spark: SparkSession, sf_dir: str, as_csv: bool) -> DataFrame:
    rows, layout = views.predictions(spark, sf_dir)
    path = scratch_path(spark, "true-pred")
    files.write_nested_predictions(experiments.nest_predictions(rows, layout), path, as_csv)
    columns = "sample_id BIGINT, part BIGINT, time BIGINT"
    return files.read_nested_predictions(spark, path, columns, as_csv).select(
        "sample_id",
        "part",
        F.size("true").cast("bigint").alias("n"),
        as_text("true").alias("true_values"),
        as_text("pred").alias("pred_values"),
    )


@query
def write_true_pred(spark, sf_dir):
    return _stored_predictions(spark, sf_dir, as_csv=False)


@query
def write_true_pred_text(spark, sf_dir):
    return _stored_predictions(spark, sf_dir, as_csv=True)


@query
def write_config(spark, sf_dir):
    path = scratch_path(spark, "config")
    rows = views.config(spark, sf_dir)
    # the second run finds half of its folders there already
    files.write_config(rows.where("folder % 2 = 0"), path)
    files.write_config(rows.withColumn("origin", F.when(F.col("folder") % 2 == 0, F.lit("second")).otherwise(F.col("origin"))), path)
    return spark.read.schema(rows.schema).json(path)


@query
def write_info(spark, sf_dir):
    rows = views.parsed(spark, sf_dir)
    path = scratch_path(spark, "info")
    longest = views.lengths(spark, sf_dir).agg(F.max("length"))
    observed = rows.agg(
        F.array(F.min("input_voltage"), F.max("input_voltage")).alias("input_range"),
        F.array(F.min("el_power"), F.max("el_power")).alias("output_range"),
    ).withColumn("max_length", longest.scalar())
    files.write_info(views.info(spark), path)
    files.write_info(observed, path)
    return files.read_info(spark, path).select(
        F.col("input_range")[0].alias("input_lo"),
        F.col("input_range")[1].alias("input_hi"),
        F.col("output_range")[0].alias("output_lo"),
        F.col("output_range")[1].alias("output_hi"),
        "max_length",
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = views.predictions(spark, sf_dir)
    return views.with_split(scores.regression_metrics(rows))


@query
def write_result(spark, sf_dir):
    rows, _ = views.history(spark, sf_dir)
    best = rows.agg(F.min_by("epoch", F.struct("val_loss", "epoch")))
    path = scratch_path(spark, "result")
    summary = scores.rmse_summary(_scored(spark, sf_dir))
    by_split = {s: summary.where(F.col("split") == s) for s in ("train", "test")}
    written = spark.range(1).select(
        best.scalar().alias("best_epoch"),
        F.lit("0:00:01.500000").alias("train_time"),
        *[
            by_split[s].select(f"rmse_{stat}").scalar().alias(f"{s}_rmse_{stat}")
            for s in ("train", "test")
            for stat in ("mean", "std")
        ],
    )
    files.write_result(written, path)
    return spark.read.schema(files.RESULT_SCHEMA).json(path)


@query
def scan_results(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    by_folder = customers.groupBy(
        F.col("c_mktsegment").alias("ex_name"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("approach")
    )
    settings = by_folder.agg(
        F.min("c_custkey").alias("seed"), F.count("*").alias("n_train_samples"), F.min("c_name").alias("loss_function")
    )
    outcomes = by_folder.agg(F.max("c_custkey").alias("best_epoch"), F.avg("c_acctbal").alias("test_rmse_mean"))
    path = scratch_path(spark, "results")
    for rows, kind in ((settings, "config.json"), (outcomes.where("best_epoch % 7 <> 0"), "result.json")):
        rows = rows.withColumn("kind", F.lit(kind)).repartition("ex_name", "approach")
        rows.write.partitionBy("ex_name", "approach", "kind").mode("append").json(path)
    found = result_files.scan_results(spark, path, config_name="kind=config.json", result_name="kind=result.json")
    return found.select(
        "folder", "seed", "n_train_samples", "loss_function", "best_epoch", r6("test_rmse_mean").alias("test_rmse_mean")
    )


# ---- projections and filters ---------------------------------------------------------------------------------------


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.join_config_result(views.config(spark, sf_dir), views.result(spark, sf_dir))


@query
def project_results(spark, sf_dir):
    return experiments.project_results(_joined(spark, sf_dir)).withColumn("test_rmse_mean", r6("test_rmse_mean"))


def _lagged(spark: SparkSession, sf_dir: str, n_in: int = LAG - 1, n_out: int = 1) -> DataFrame:
    rows, layout = views.signals(spark, sf_dir)
    return features.lag_features(rows, ["input_voltage", "el_power"], n_in, n_out, layout)


@query
def select_features(spark, sf_dir):
    lagged = _lagged(spark, sf_dir)
    return lagged.select("sample_id", "time", *features.select_features(lagged, "input_voltage"))


@query
def rename_lags(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    bare = rows.select("sample_id", "time", F.col("input_voltage").alias("var1"), F.col("el_power").alias("var2"))
    lagged = features.lag_features(bare, ["var1", "var2"], 1, 2, layout)
    offsets = {"_t_minus_1": "(t-1)", "_t": "(t)", "_t_plus_1": "(t+1)"}
    raw = lagged.withColumnsRenamed({f"{v}{k}": f"{v}{o}" for v in ("var1", "var2") for k, o in offsets.items()})
    return features.rename_lags(raw, ["input_voltage", "el_power"])


@query
def dropna_rows(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    return features.forward_diff(rows, "input_voltage", "diff", layout).select(
        "sample_id", "time", r6("diff").alias("diff")
    )


def _test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"))
    return ids.where(F.col("sample_id") % views.TEST_EVERY == 0).distinct()


@query
def split_test(spark, sf_dir):
    marked = splits.split_test(views.parsed(spark, sf_dir), _test_ids(spark, sf_dir))
    return marked.groupBy("split", "sample_id").agg(F.count("*").alias("n"), r6(F.sum("el_power")).alias("el_power"))


@query
def split_pool(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    ids = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"))
    marked = splits.split_test(rows, [4, 12], pool=ids.where("sample_id < 100"), drop_unused=False)
    return marked.select("sample_id", "time", "split")


@query
def static_vs_slope(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    found = segments.static_segments(rows, "el_power", layout)
    return found.groupBy("sample_id").agg(
        F.count_if("is_static").alias("static_segments"),
        F.count_if(~F.col("is_static")).alias("slope_segments"),
        F.max(F.when(F.col("is_static"), F.col("length"))).alias("longest_static"),
        F.max(F.when(~F.col("is_static"), F.col("length"))).alias("longest_slope"),
    )


@query
def align_tail(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    return features.align_tail(rows, LAG, layout).select("sample_id", "time", "el_power")


# ---- joins -----------------------------------------------------------------------------------------------------------


@query
def join_config_result(spark, sf_dir):
    return _joined(spark, sf_dir).withColumn("test_rmse_mean", r6("test_rmse_mean"))


@query
def scale_by_bounds(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    scaled = features.scale_by_bounds(
        rows, views.info(spark), {"input_voltage": "input_range", "el_power": "output_range"}
    )
    return scaled.select(
        "sample_id", "time", r6("input_voltage").alias("input_voltage"), r6("el_power").alias("el_power")
    )


@query
def align_xy(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    return features.align_xy(rows, ["input_voltage"], "el_power", LAG - 1, layout)


@query
def split_overlap(spark, sf_dir):
    ids = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"))
    return splits.split_overlap(splits.sample_train(ids, 40, seed=7), _test_ids(spark, sf_dir))


@query
def step_fill(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    points = response.change_points(rows, "el_power", layout)
    return response.step_fill(points, views.lengths(spark, sf_dir), "el_power", layout)


@query
def tgds_sweep(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    lo, hi = views.OUTPUT_RANGE
    losses = consistency.tgds_sweep(steps, experiments.grid_rules(lo, hi))
    grid = experiments.with_rule_columns(experiments.experiment_grid(spark), lo, hi)
    rule = ["rule_theta", "tgds_ratio", "loss_tolerance", "steepness_scaled"]
    return grid.join(losses.withColumnRenamed("theta", "rule_theta").drop("normalized"), rule).select(
        F.col("config_id").cast("bigint").alias("config_id"),
        F.col("run").cast("bigint").alias("run"),
        "ex_name",
        F.col("train_size").cast("bigint").alias("train_size"),
        grid["loss"].alias("loss_function"),
        "batches",
        r6("mse").alias("mse"),
        r6("tgds").alias("tgds"),
        F.round(losses["loss"], 4).alias("loss"),
    )


# ---- aggregations ----------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


@query
def regression_metrics(spark, sf_dir):
    rows, _ = views.predictions(spark, sf_dir)
    out = scores.regression_metrics(rows)
    # The relative error is huge where the truth is 0: significant digits, not places.
    return _rounded(out, "mse", "rmse", "r2", "mae", "maxae").withColumn("mape", F.expr(SIGNIFICANT.format("mape")))


@query
def trimmed_rmse(spark, sf_dir):
    size = views.event_size(spark, sf_dir)
    rows, _ = views.predictions(spark, sf_dir, size)
    scored = views.with_split(scores.regression_metrics(rows))
    # A split has at most one score per series.
    bound = Size(size.groups, size.groups, 2)
    return scores.trimmed_rmse(scored, size=bound)


@query
def rmse_summary(spark, sf_dir):
    return scores.rmse_summary(_scored(spark, sf_dir))


@query
def results_rollup(spark, sf_dir):
    return _rounded(scores.results_rollup(_joined(spark, sf_dir)), "mean", "std")


@query
def bootstrap_ci(spark, sf_dir):
    out = scores.bootstrap_ci(
        _joined(spark, sf_dir), ("loss_function", "n_train_samples"), "test_rmse_mean", "folder", REPS, LEVEL
    )
    return out.withColumns({c: F.expr(SIGNIFICANT.format(c)) for c in ("mean", "ci_low", "ci_high")})


@query
def run_lists(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    runs = segments.value_runs(rows, "el_power", "run_id", layout)
    return segments.run_lists(runs, "el_power", "run_id", layout).select(
        "sample_id", "run_id", "part", as_text("items").alias("items"), "length"
    )


@query
def segment_stats(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    return segments.segment_stats(rows, "el_power", layout)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, layout = views.scaled_predictions(spark, sf_dir)
    return consistency.abs_differences(
        consistency.batch_blocks(rows, layout=layout, sizes=views.tail_sizes(spark, sf_dir, 1))
    )


@query
def tgds_loss_by_batch(spark, sf_dir):
    out = consistency.tgds_loss_by_batch(_steps(spark, sf_dir), RULE)
    return _rounded(out, "mse", "static", "trans", "tgds", "loss")


@query
def tgds_loss_by_sample(spark, sf_dir):
    rows, layout = views.scaled_predictions(spark, sf_dir)
    blocks = consistency.batch_blocks(rows, 16, "sample", layout)
    batch = ("sample_id", "batch_no")
    steps = consistency.abs_differences(blocks, batch=batch)
    out = consistency.tgds_loss_by_batch(steps, NORMALIZED_RULE, batch)
    return _rounded(out, "mse", "static", "trans", "tgds", "loss")


@query
def tgds_metric(spark, sf_dir):
    return _rounded(consistency.tgds_metric(_steps(spark, sf_dir), METRIC_RULE), "total", "loss_tgds")


@query
def tgds_metric_by_day(spark, sf_dir):
    """The metric from stored parts: one of each 64 batches, the last of them stored twice."""
    path = scratch_path(spark, "metric")
    steps = _steps(spark, sf_dir).withColumn("day", F.floor(F.col("batch_no") / 64))
    days = settle(consistency.metric_state(steps, METRIC_RULE, ("day", "batch_no"), ("day",)))
    result_files.store_metric(days, path, "day")
    result_files.store_metric(days.where(F.col("day") == days.agg(F.max("day")).scalar()), path, "day")
    return _rounded(consistency.metric_of(result_files.read_metric(spark, path, days.schema), METRIC_RULE), "total", "loss_tgds")


@query
def best_epoch(spark, sf_dir):
    rows, _ = views.history(spark, sf_dir)
    return history.best_epoch(rows)


@query
def sample_lengths(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    return segments.sample_lengths(rows, layout)


# ---- windows ---------------------------------------------------------------------------------------------------------


@query
def lag_features(spark, sf_dir):
    return _lagged(spark, sf_dir, LAG - 1, 2)


@query
def lag_array(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    arrays = features.lag_array(rows, "el_power", 16, "features", layout)
    return arrays.select("sample_id", "time", as_text("features").alias("features"))


@query
def abs_diff(spark, sf_dir):
    steps = _steps(spark, sf_dir).where(F.col("d").isNotNull())
    return steps.select("batch_no", "row_no", r6("d").alias("d"))


@query
def forward_diff(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    return features.forward_diff(rows, "el_power", "diff", layout).select("sample_id", "time", "diff")


@query
def value_runs(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    return segments.value_runs(rows, "el_power", "run_id", layout).select("sample_id", "time", "el_power", "run_id")


@query
def static_segments(spark, sf_dir):
    rows, layout = views.levels(spark, sf_dir)
    return segments.static_segments(rows, "el_power", layout)


@query
def batch_blocks(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    return consistency.batch_blocks(rows, layout=layout, sizes=views.tail_sizes(spark, sf_dir, 0)).select("sample_id", "time", "row_no", "batch_no")


@query
def running_batch_loss(spark, sf_dir):
    rows = views.batch_history(spark, sf_dir)
    layout = replace(history.BATCHES, longest=10)
    return _rounded(history.running_batch_loss(rows, layout), "running_loss")


@query
def checkpoint_epochs(spark, sf_dir):
    rows, layout = views.history(spark, sf_dir)
    return history.checkpoint_epochs(rows, layout)


@query
def early_stop_epoch(spark, sf_dir):
    rows, layout = views.history(spark, sf_dir)
    return history.early_stop_epoch(rows, PATIENCE, layout)


@query
def first_nan_batch(spark, sf_dir):
    return history.first_nan_batch(views.batch_history(spark, sf_dir))


# ---- sorts, samples, sets --------------------------------------------------------------------------------------------


@query
def order_samples(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"))
    return splits.order_samples(rows)


@query
def sample_train(spark, sf_dir):
    ids = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"))
    pool = ids.where(F.col("sample_id") % views.TEST_EVERY != 0)
    return splits.sample_train(pool, 6, seed=42)


@query
def tail_split(spark, sf_dir):
    rows, layout = views.signals(spark, sf_dir)
    sizes = views.tail_sizes(spark, sf_dir, 0)
    return splits.tail_split(rows, VAL_FRAC, layout=layout, sizes=sizes).select("sample_id", "time", "row_no", "split")


@query
def union_samples(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    rows = rows.select("sample_id", "time", "input_voltage", "el_power")
    return features.union_samples([rows.where(F.col("sample_id") % 3 == k) for k in range(3)])


@query
def experiment_grid(spark, sf_dir):
    pool = views.lengths(spark, sf_dir).where(F.col("sample_id") % views.TEST_EVERY != 0)
    draws = splits.sample_train_runs(pool, max(experiments.TRAIN_SIZES), SEEDS).join(pool, "sample_id")
    by_size = draws.withColumn(
        "train_size", F.explode(F.sequence(F.col("draw_no"), F.lit(max(experiments.TRAIN_SIZES))))
    )
    training = by_size.groupBy("run", "train_size").agg(
        F.sum("length").alias("train_rows"), as_text(F.sort_array(F.collect_list("sample_id"))).alias("train_samples")
    )
    ints = ("config_id", "run", "train_size", "train_rows")
    out = experiments.experiment_grid(spark).join(training, ["run", "train_size"]).drop("setting_no")
    return _rounded(out, "steepness").withColumns({c: F.col(c).cast("bigint") for c in ints})


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query
def minmax_scale(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    lo, hi = (F.lit(v) for v in views.INPUT_RANGE)
    return rows.select("sample_id", "time", r6(scaling.minmax_scale(F.col("input_voltage"), lo, hi)).alias("scaled"))


@query
def minmax_inverse(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    lo, hi = (F.lit(v) for v in views.OUTPUT_RANGE)
    share = F.col("input_voltage") / 500
    return rows.select("sample_id", "time", r6(scaling.minmax_inverse(share, lo, hi)).alias("unscaled"))


@query
def scale_steepness(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    lo, hi = (F.lit(v) for v in views.OUTPUT_RANGE)
    steps = rows.groupBy("sample_id").agg(F.avg("el_power").alias("steepness"))
    return steps.select(
        "sample_id",
        r6(scaling.scale_steepness(F.col("steepness"), lo, hi)).alias("affine"),
        r6(scaling.scale_steepness(F.col("steepness"), lo, hi, "linear")).alias("linear"),
    )


@query
def band_deviation(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    off = physics.band_deviation(F.col("el_power"), F.lit(25.0), F.lit(75.0))
    return rows.select("sample_id", "time", r6(off).alias("deviation"))


@query
def static_curve(spark, sf_dir):
    rows, _ = views.signals(spark, sf_dir)
    return rows.select("sample_id", "time", F.round(physics.static_curve(F.col("input_voltage") / 100), 9).alias("output"))


def _response(spark: SparkSession, sf_dir: str):
    rows, layout = views.levels(spark, sf_dir)
    points = response.change_points(rows, "el_power", layout)
    lengths = views.lengths(spark, sf_dir)
    return rows, layout, response.expected_response(points, lengths, "el_power", RESPONSE_STEEPNESS, layout)


@query
def expected_response(spark, sf_dir):
    _, _, expected = _response(spark, sf_dir)
    return _rounded(expected, "expected")


@query
def response_residuals(spark, sf_dir):
    rows, layout, expected = _response(spark, sf_dir)
    resting = rows.select("sample_id", "time", physics.static_curve(F.col("el_power").cast("double")).alias("y_true"))
    both = features.join_aligned(resting, expected.withColumnRenamed("expected", "y_pred"), layout)
    return scores.regression_metrics(both).select(
        "sample_id", "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("maxae").alias("maxae")
    )


@query
def parse_path(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    path = F.concat_ws(
        "/",
        F.lit("Results"),
        F.col("event_type"),
        F.concat(F.lit("user-"), F.col("user_id")),
        F.concat(F.lit("sample_"), F.col("event_id"), F.lit(".csv")),
    )
    rows = events.select("event_id", path.alias("path"))
    return rows.select(
        "event_id",
        text.path_tail(F.col("path")).alias("folder"),
        text.series_number(F.col("path")).alias("sample_no"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
    )


@query
def parse_duration(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    clock = F.format_string(
        "%d:%02d:%02d.%06d",
        F.col("user_id") % 24,
        F.col("event_id") % 60,
        F.col("event_id") % 59,
        F.col("event_id") % 1000000,
    )
    days = F.col("event_id") % 3
    shown = F.when(days == 0, clock).otherwise(F.concat(days, F.when(days == 1, " day, ").otherwise(" days, "), clock))
    rows = events.select("event_id", shown.alias("duration"))
    return rows.select("event_id", r6(text.parse_duration(F.col("duration"))).alias("seconds"))


@query
def explode_true_pred(spark, sf_dir):
    rows, layout = views.predictions(spark, sf_dir)
    return experiments.explode_true_pred(experiments.nest_predictions(rows, layout), layout)


@query
def json_merge(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    both = F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("k")))
    other = F.when(F.col("event_id") % 2 == 0, both).otherwise(F.to_json(F.struct(F.col("event_type").alias("t"))))
    merged = events.select("event_id", text.json_merge(F.col("props"), other).alias("m"))
    return merged.select(
        "event_id",
        F.col("m")["k"].cast("bigint").alias("k"),
        F.col("m")["t"].alias("t"),
        F.size("m").cast("bigint").alias("entries"),
    )


# ---- streams ---------------------------------------------------------------------------------------------------------


def _keep_slices(spark: SparkSession, sf_dir: str, length: str) -> str:
    rows = live.read_event_stream(spark, f"{sf_dir}/events.parquet")
    path, state = scratch_path(spark, "stream-slices"), scratch_path(spark, "stream-state")
    live.keep_slices(rows, path, state, STREAM_RULE, "el_power", length).awaitTermination()
    return path


@query
def stream_tgds(spark, sf_dir):
    path = _keep_slices(spark, sf_dir, STREAM_SLICE)
    windows = live.window_scores(live.latest_slices(spark, path, STREAM_RULE), STREAM_RULE, STREAM_WINDOW)
    return _rounded(live.total_score(windows, STREAM_RULE), "total", "loss_tgds")


@query
def stream_batch_log(spark, sf_dir):
    path = _keep_slices(spark, sf_dir, STREAM_WINDOW)
    log = live.window_scores(live.closed_slices(spark, path, STREAM_RULE, delay=None), STREAM_RULE, STREAM_WINDOW)
    return _rounded(log, "moving", "still", "total").select(
        "sample_id", F.unix_seconds("window_start").alias("window_start"), "n", "steps", "moving", "still", "total"
    )


# ---- models ----------------------------------------------------------------------------------------------------------


def _model_rows(spark: SparkSession, sf_dir: str):
    """Scaled lag-2 rows of all series with their split, and the layout."""
    rows, layout = views.signals(spark, sf_dir)
    scaled = features.scale_by_bounds(
        rows, views.info(spark), {"input_voltage": "input_range", "el_power": "output_range"}
    )
    lagged = features.lag_features(scaled, ["input_voltage", "el_power"], 1, 1, layout)
    return views.with_split(lagged), features.select_features(lagged, "input_voltage"), layout


@query
def fit_lag_baseline(spark, sf_dir):
    rows, names, _ = _model_rows(spark, sf_dir)
    fitted = models.fit_lag_baseline(rows.where("split = 'train'"), names, "el_power_t").stages[-1]
    coefficients = dict(zip(["intercept", *names], [fitted.intercept, *fitted.coefficients.toArray().tolist()]))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in coefficients.items()], "term string, value double")


@query
def predict_samples(spark, sf_dir):
    rows, names, _ = _model_rows(spark, sf_dir)
    model = models.fit_lag_baseline(rows.where("split = 'train'"), names, "el_power_t")
    predicted = models.predict_samples(model, rows, "el_power_t", views.OUTPUT_RANGE)
    return _rounded(
        models.score_predictions(predicted).select("split", "sample_id", "n", "rmse", "mae", "maxae"), "rmse", "mae", "maxae"
    )


def _guided_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of a guided fit on the training series, validated on the test series."""
    rows, names, layout = _model_rows(spark, sf_dir)
    sizes = views.with_split(views.tail_sizes(spark, sf_dir, 1))
    batches = {
        s: consistency.batch_blocks(rows.where(F.col("split") == s), layout=layout, sizes=sizes.where(F.col("split") == s))
        for s in ("train", "test")
    }
    model = models.fit_tgds_linear(batches["train"], names, "el_power_t", GUIDED_RULE, FIT_STEPS, batches["test"])
    columns = ("loss", "mse", "tgds", "val_loss", "val_mse", "val_tgds")
    steps = [(1, h["epoch"], *(h[c] for c in columns)) for h in model.history]
    return spark.createDataFrame(steps, "run_id bigint, epoch bigint, " + ", ".join(f"{c} double" for c in columns))


@query
def fit_tgds_linear(spark, sf_dir):
    losses = ("loss", "mse", "tgds", "val_loss", "val_mse", "val_tgds")
    return _rounded(_guided_history(spark, sf_dir).drop("run_id"), *losses)


@query
def guided_replay(spark, sf_dir):
    """Best epoch, checkpoints and stop of the guided fit, from its own history."""
    rows = _guided_history(spark, sf_dir).withColumn("val_loss", r6("val_loss"))
    layout = replace(history.EPOCHS, longest=FIT_STEPS, dense=True)
    saved = history.checkpoint_epochs(rows, layout).groupBy("run_id").agg(F.max("epoch").alias("last_saved"), F.count("*").alias("saves"))
    stop = history.early_stop_epoch(rows, 1, layout)
    return history.best_epoch(rows).join(saved, "run_id").join(stop, "run_id")
