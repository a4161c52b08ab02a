"""Series files and their sidecars."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.functions.text import series_number
from tidetrace.operators.features import harmonize_columns
from tidetrace.plans.layout import SIGNALS, Layout
from tidetrace.session import settle

INFO_SCHEMA = T.StructType(
    [
        T.StructField("input_range", T.ArrayType(T.DoubleType())),
        T.StructField("output_range", T.ArrayType(T.DoubleType())),
        T.StructField("max_static_size", T.LongType()),
        T.StructField("max_lag", T.LongType()),
        T.StructField("max_length", T.LongType()),
    ]
)
CONFIG_SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("ex_name", "approach", "loss_function", "data_type")],
        *[
            T.StructField(n, T.LongType())
            for n in ("seed", "epochs", "batch_size", "neurons", "n_train_samples", "lookback")
        ],
        *[
            T.StructField(n, T.DoubleType())
            for n in (
                "learning_rate", "dropout", "lambda", "steepness_loss", "steepness_data", "tgds_ratio", "loss_tolerance",
            )
        ],
        T.StructField("loss_normalized", T.BooleanType()),
        T.StructField("train_samples", T.ArrayType(T.StringType())),
        T.StructField("test_samples", T.ArrayType(T.StringType())),
    ]
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("best_epoch", T.LongType()),
        T.StructField("train_time", T.StringType()),
        *[
            T.StructField(n, T.DoubleType())
            for n in ("train_rmse_mean", "train_rmse_std", "test_rmse_mean", "test_rmse_std")
        ],
    ]
)
#: Headers of files up to this number (some 50 MB) are sent to all tasks; more are joined by a shuffle.
SENT_FILES = 100_000
# Column order of the two variants of the experiment files.
_LEADING = ("time", "input_voltage", "el_power", "th_power")


def read_signals(spark: SparkSession, path: str, columns: str, sep: str = "|", glob: str | None = None) -> DataFrame:
    """All series files below ``path`` as one table, with ``sample_id`` from the path unless it is a column.

    ``columns`` is the DDL of the files' header. One scan reads every file; nothing is inferred.
    """
    reader = spark.read.schema(columns).option("sep", sep).option("header", True).option("enforceSchema", False)
    reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.csv(path)
    if "sample_id" in rows.columns:
        return rows
    return rows.select(series_number(F.col("_metadata.file_path")).alias("sample_id"), "*")


def read_experiments(spark: SparkSession, paths_by_extra: dict[str, list[str]]) -> DataFrame:
    """Experiment files of both header variants, ``{extra column: paths}``, without the columns that differ."""
    frames = []
    for extra, paths in paths_by_extra.items():
        ddl = ", ".join(f"{c} DOUBLE" for c in (*_LEADING, extra))
        rows = spark.read.schema(ddl).option("sep", "|").option("header", True).csv(paths)
        numbered = rows.select(series_number(F.col("_metadata.file_path")).alias("sample_id"), "*")
        frames.append(harmonize_columns(numbered))
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other)
    return first.withColumn("time", F.col("time").cast("bigint"))


def read_by_header(
    spark: SparkSession, path: str | list[str], columns: str, sep: str = "|", glob: str | None = None
) -> DataFrame:
    """Series files whose headers differ, as one table with the columns of the DDL ``columns``, whatever their order in a file.

    Each file's first line is its header. Columns that aren't asked for are left out; those that a file lacks, and values that
    aren't of the column's type, are NULL there. ``sample_id`` comes from the path unless it is asked for. Files hold no quotes.

    One pass finds the headers, a second reads all files, each line by the header of its file; nothing is brought to the driver
    but the number of files.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # within the split that begins a file, rows are numbered in the order of its lines
    begun = lines.where("start = 0").withColumn("line", F.monotonically_increasing_id())
    headers = settle(begun.groupBy("file").agg(F.min_by("value", "line").alias("header")))
    cut = lambda line: F.transform(F.split(line, re.escape(sep)), lambda x: F.trim(x))
    wanted = T.StructType.fromDDL(columns)
    headers = headers.withColumn("names", cut("header"))
    place = lambda name: F.nullif(F.array_position("names", name), F.lit(0)).cast("int").alias(name)
    headers = headers.select("file", "header", F.struct(*[place(f.name) for f in wanted]).alias("place"))
    few = headers.count() <= SENT_FILES
    rows = lines.drop("start").join(F.broadcast(headers) if few else headers, "file").where("value != header")
    rows = rows.withColumn("fields", cut("value"))
    value = lambda f: F.get("fields", F.col("place")[f.name] - 1).try_cast(f.dataType).alias(f.name)
    found = [value(f) for f in wanted]
    if "sample_id" not in wanted.names:
        found.insert(0, series_number(F.col("file")).alias("sample_id"))
    return rows.select(*found)


def write_signals(df: DataFrame, path: str, sep: str = "|", series_per_folder: int = 1000, layout: Layout = SIGNALS) -> None:
    """CSV files in one folder per ``series_per_folder`` ids.

    With 1, each series has its own folder and its id is in the path only, as in a one-file-per-series collection; that
    many small files suit few series. Tasks write equal ranges of (series, tick), so a folder has few files and a long
    series is written by several tasks.
    """
    (key,) = layout.keys
    if series_per_folder == 1:
        folder, rows = key, df
    else:
        folder, rows = "series_block", df.withColumn("series_block", F.floor(F.col(key) / series_per_folder))
    ranged = rows.repartitionByRange(key, layout.tick)
    ranged.write.partitionBy(folder).option("sep", sep).option("header", True).mode("errorifexists").csv(path)


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Histories and score tables as CSV."""
    df.write.option("sep", sep).option("header", True).mode("errorifexists").csv(path)


def read_table(spark: SparkSession, path: str, columns: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(columns).option("sep", sep).option("header", True).csv(path)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """Bounds and lengths of a dataset: one row."""
    return spark.read.schema(INFO_SCHEMA).option("multiLine", True).json(path)


def write_info(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


write_result = write_info


def write_config(df: DataFrame, path: str, run: str = "folder") -> None:
    """Add the configs of runs that have none yet; an existing config stays as it is. ``run`` tells runs apart."""
    try:
        known = df.sparkSession.read.schema(df.schema).json(path).select(run)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        df = df.join(known, run, "left_anti").select(*df.columns)
    df.write.mode("append").json(path)


def write_nested_predictions(df: DataFrame, path: str, text: bool = False) -> None:
    """Nested predictions with real lists (Parquet), or as CSV with the lists as JSON text."""
    if text:
        texts = df.withColumns({c: F.to_json(c) for c in ("true", "pred")})
        texts.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def read_nested_predictions(spark: SparkSession, path: str, columns: str, text: bool = False) -> DataFrame:
    """Nested predictions as written; ``columns`` is the DDL of the other columns, which come first."""
    if not text:
        return spark.read.schema(f"{columns}, true ARRAY<DOUBLE>, pred ARRAY<DOUBLE>").parquet(path)
    rows = spark.read.schema(f"{columns}, true STRING, pred STRING").option("header", True).option("escape", '"').csv(path)
    return rows.withColumns({c: F.from_json(c, "array<double>") for c in ("true", "pred")})
