"""Trees of experiment results."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.operators.experiments import join_config_result
from tidetrace.sources.signals import CONFIG_SCHEMA, RESULT_SCHEMA


def read_json_tree(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """Every object of every ``name`` below ``root``, at any depth, with ``folder`` = its path below ``root``.

    ``name`` is a JSON file, or a folder of that name as Spark writes one. A file has an object in each line, or a single one
    over several lines; files with a line that isn't an object are read as the latter. Files are told apart by a filter on
    their path, which prunes the listing before anything is read.
    """
    path = F.col("_metadata.file_path")
    file, top = re.escape(name), re.escape(root.strip("/"))

    def wanted(rows: DataFrame) -> DataFrame:
        return rows.where(path.rlike(rf"/{file}(/[^/]*)?$")).select(path.alias("_path"), "*")

    bad = "_bad"
    options = {"columnNameOfCorruptRecord": bad}
    lines = wanted(spark.read.option("recursiveFileLookup", True).text(root)).where(F.trim("value") != "")
    parsed = lines.select("_path", F.from_json("value", _with(schema, bad), options).alias("o"))
    whole = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    spread = parsed.where(F.col(f"o.{bad}").isNotNull()).select("_path").distinct()
    single = parsed.join(spread, "_path", "left_anti").select("_path", "o.*").drop(bad)
    rows = single.unionByName(wanted(whole).join(spread, "_path", "left_semi"))
    home = F.regexp_extract("_path", rf"^.*{top}/(.*?)/?{file}(?:/[^/]*)?$", 1)
    return rows.select(F.concat(home, F.lit("/")).alias("folder"), *schema.names)


def _with(schema: T.StructType, column: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(column, T.StringType())])


def scan_results(
    spark: SparkSession,
    root: str,
    config_schema: T.StructType = CONFIG_SCHEMA,
    result_schema: T.StructType = RESULT_SCHEMA,
    config_name: str = "config.json",
    result_name: str = "result.json",
) -> DataFrame:
    """One row per folder with both a config and a result."""
    config = read_json_tree(spark, root, config_name, config_schema)
    result = read_json_tree(spark, root, result_name, result_schema)
    return join_config_result(config, result)


def store_metric(states: DataFrame, path: str, period: str) -> None:
    """Keep states in a folder per ``period``, a column such as the day of their batches. Those of a period replace what it had, so
    a job that is run again adds nothing twice; other periods stay."""
    states.write.partitionBy(period).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_metric(spark: SparkSession, path: str, schema: T.StructType, since: Column | None = None) -> DataFrame:
    """Stored states, all or those for which ``since``, a condition on the period, holds: a reset only moves that bound, and
    folders before it aren't read. A store that nothing was written to has no states."""
    try:
        states = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        states = spark.createDataFrame([], schema)
    return states if since is None else states.where(since)
