"""What several operators share: tables in the shared folder, row ids, words of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidetrace.session import scratch_path

#: A word: a run of anything but a blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Names of files up to this number (some 20 MB) are sent to all tasks; more are joined by a shuffle.
SENT_FILES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder all executors share: computed once, and no lineage to lose."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def written_in_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of ``parts``, of the same columns, as one Parquet table like ``written``. A part is computed when the one before is
    written and its shuffle files are given up, so that the parts of a large job take turns on disk."""
    path = None
    for df in parts:
        path = path or scratch_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
        free_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made, once all that was computed from them is written too."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of jobs that are over when the driver collects its garbage; do so after a large one."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 22) -> Iterator[None]:
    """Arrow batches of up to ``rows`` rows and ``size`` bytes or so, in what is planned meanwhile: a task and its worker hold several."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (Spark ignores the case of names)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A number for each row, written with the rows: every pass reads the same numbers, however a scan is split."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_scan_id(df: DataFrame, name: str) -> DataFrame:
    """A number for each row of a scanned table, ``df``, to which columns may have been added and from which rows may have been left
    out: the number of its file and the row's place there, which are the same in every pass and need no copy of the rows.
    """
    path, place = free_name(df, "_path"), free_name(df, "_place")
    scanned = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    files = scanned.select(path).distinct()
    # a file in a line: this table has no more rows than the collection has files
    order = Window.partitionBy(F.lit(0)).orderBy(path)
    files = written(files.withColumn(name, F.row_number().over(order).cast("bigint")), "files")
    few = files.count() <= SENT_FILES
    numbered = scanned.join(F.broadcast(files) if few else files, path)
    return numbered.withColumn(name, F.shiftleft(name, 40) + F.col(place)).drop(path, place)


def count_words(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
