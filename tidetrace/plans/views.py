"""Series, predictions, histories and experiments read off the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetrace.operators.features import persistence_predictions
from tidetrace.operators.history import EPOCHS
from tidetrace.plans.layout import SIGNALS, Layout, Size, measure, ordinals

# Declared bounds of the series below.
INPUT_RANGE = (-1.0, 500.0)
OUTPUT_RANGE = (-1.0, 100.0)
LEVEL_WIDTH = 34
TEST_EVERY = 5


SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by its known schema, so no job is spent on reading footers."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per series, from the key column alone."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("sample_id")).agg(F.count("*").alias("length"))


def tail_sizes(spark: SparkSession, sf_dir: str, first_tick: int) -> DataFrame:
    """Rows per series from ``first_tick`` on; series without any are left out."""
    rest = lengths(spark, sf_dir).where(F.col("length") > first_tick)
    return rest.select("sample_id", (F.col("length") - first_tick).alias("length"), F.lit(first_tick).alias("first_tick"))


def event_size(spark: SparkSession, sf_dir: str) -> Size:
    return measure(table(spark, sf_dir, "events"), ("user_id",))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of series, not numbered yet. Parsed before any shuffle, which then moves a number and not JSON text."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"),
        F.col("value").alias("input_voltage"),
        F.get_json_object("props", "$.k").cast("double").alias("el_power"),
        "ts",
        "event_id",
    )


def signals(spark: SparkSession, sf_dir: str, size: Size | None = None) -> tuple[DataFrame, Layout]:
    """Events of a user as a series with dense ticks, and its layout with the measured longest series."""
    size = size or event_size(spark, sf_dir)
    rows = ordinals(parsed(spark, sf_dir), ("sample_id",), ("ts", "event_id"), "time", size)
    return rows, replace(SIGNALS, longest=size.longest, dense=True)


def levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """Three output levels, so that runs exist."""
    rows, layout = signals(spark, sf_dir)
    level = F.floor(F.col("el_power") / LEVEL_WIDTH).cast("bigint")
    return rows.select("sample_id", "time", "input_voltage", level.alias("el_power")), layout


def predictions(spark: SparkSession, sf_dir: str, size: Size | None = None) -> tuple[DataFrame, Layout]:
    rows, layout = signals(spark, sf_dir, size)
    return persistence_predictions(rows, "el_power", layout), layout


def scaled_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """Predictions in [0, 1], as the loss sees them."""
    rows, layout = predictions(spark, sf_dir)
    lo, hi = OUTPUT_RANGE
    scaled = {c: (F.col(c) - F.lit(lo)) / F.lit(hi - lo) for c in ("y_true", "y_pred")}
    return rows.withColumns(scaled), layout


def with_split(df: DataFrame) -> DataFrame:
    test = F.col("sample_id") % TEST_EVERY == 0
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def info(spark: SparkSession) -> DataFrame:
    def bounds(pair: tuple[float, float]):
        return F.array(*[F.lit(v) for v in pair])

    return spark.range(1).select(bounds(INPUT_RANGE).alias("input_range"), bounds(OUTPUT_RANGE).alias("output_range"))


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    rows, layout = signals(spark, sf_dir)
    renamed = rows.select(
        F.col("sample_id").alias("run_id"),
        (F.col("time") + 1).alias("epoch"),
        F.col("el_power").alias("loss"),
        F.col("input_voltage").alias("val_loss"),
    )
    return renamed, replace(EPOCHS, longest=layout.longest + 1, dense=True)


def batch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten batches an epoch; the loss is NaN where the output is 13."""
    rows, _ = signals(spark, sf_dir)
    return rows.select(
        F.col("sample_id").alias("run_id"),
        F.floor(F.col("time") / 10).cast("bigint").alias("epoch"),
        (F.col("time") % 10).alias("batch"),
        F.when(F.col("el_power") == 13, F.lit(float("nan"))).otherwise(F.col("input_voltage")).alias("loss"),
        (F.col("time") % 10 + 119).alias("n"),
    )


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("folder"),
        F.col("c_mktsegment").alias("loss_function"),
        (F.col("c_nationkey") % 6 + 1).cast("bigint").alias("n_train_samples"),
        F.lit("config").alias("origin"),
    )


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    means = orders.groupBy(F.col("o_custkey").alias("folder")).agg(F.avg("o_totalprice").alias("test_rmse_mean"))
    return means.withColumn("origin", F.when(F.col("folder") % 2 == 0, F.lit("result")))
