"""The two-state score kept up to date on a stream.

A batch of the score is one series in one tumbling event-time window. The stream keeps windows as slices, and a slice as
segments: a segment is a stretch of rows of one series in one slice that has been scored, with its bounds in time, its first
and last value, its rows and both error sums. Segments that don't overlap merge: their sums add up, with the step from the
last value of one to the first of the next. So a trigger scores its own rows only, whatever has been stored before, and
``latest_slices`` merges segments when the result is read. Only where rows of different triggers interleave in time are the
rows of those stretches read again. So scores don't depend on the order in which rows arrive or on how many files a trigger takes.

``compact`` merges the segments stored so far; ``expire`` drops the rows of slices that are over, whose segments stay. Rows
that come for such a slice later are kept apart (``late_rows``), all others are never too late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidetrace.functions.physics import TwoState

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_ROWS = "slice_start TIMESTAMP, slice_end TIMESTAMP, sample_id BIGINT, ts TIMESTAMP, event_id BIGINT, value DOUBLE, batch BIGINT, day DATE"
_PLACE = "STRUCT<ts: TIMESTAMP, event_id: BIGINT>"
_SEGMENTS = (
    "slice_start TIMESTAMP, slice_end TIMESTAMP, sample_id BIGINT, n BIGINT, moving DOUBLE, still DOUBLE, first DOUBLE, last DOUBLE, "
    f"newest TIMESTAMP, lo {_PLACE}, hi {_PLACE}, batch BIGINT"
)
_SLICE = ["slice_start", "slice_end", "sample_id"]
#: A series' rows within a slice are scored in cells of so much time, so that a busy series is many tasks' work.
CELL = "5 minutes"


def read_event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of a table, one file or a folder of them, as ``(sample_id, ts, event_id, input_voltage, el_power)``.

    A stream takes a single file only where the path is a pattern, so the last character is made one.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return rows.select(
        F.col("user_id").alias("sample_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("input_voltage"),
        F.get_json_object("props", "$.k").cast("double").alias("el_power"),
    )


def with_slice(rows: DataFrame, length: str) -> DataFrame:
    """Adds the start and end of each row's slice."""
    window = F.window("ts", length)
    return rows.withColumns({"slice_start": window["start"], "slice_end": window["end"]})


def slice_scores(rows: DataFrame, rule: TwoState, value: str = "value", cell: str = CELL) -> DataFrame:
    """Per (series, slice): rows, both error sums over the steps inside, first and last value, newest time, and the places of
    the first and last row. Rows are scored by cells of time first, and the cells merged."""
    return merged(_scored(rows.withColumn("_cell", F.window("ts", cell)["start"]), rule, value, [*_SLICE, "_cell"]), rule, _SLICE)


def _scored(rows: DataFrame, rule: TwoState, value: str, keys: list[str]) -> DataFrame:
    """A segment of the rows of each key."""
    place = F.struct("ts", "event_id")
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    steps = rows.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(order)))
    total = lambda error: F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), error(F.col("_d")))), F.lit(0.0))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n"),
        total(rule.moving_error).alias("moving"),
        total(rule.static_error).alias("still"),
        F.min_by(value, place).alias("first"),
        F.max_by(value, place).alias("last"),
        F.max("ts").alias("newest"),
        F.min(place).alias("lo"),
        F.max(place).alias("hi"),
    )


def merged(segments: DataFrame, rule: TwoState, keys: list[str]) -> DataFrame:
    """One segment per key of segments that don't overlap: sums, and the steps from each to the next."""
    order = Window.partitionBy(*keys).orderBy("lo")
    joined = segments.withColumn("_d", F.abs(F.col("first") - F.lag("last").over(order)))
    between = lambda error: F.coalesce(F.sum(error(F.col("_d"))), F.lit(0.0))
    return joined.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("moving") + between(rule.moving_error)).alias("moving"),
        (F.sum("still") + between(rule.static_error)).alias("still"),
        F.min_by("first", "lo").alias("first"),
        F.max_by("last", "hi").alias("last"),
        F.max("newest").alias("newest"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


def window_scores(slices: DataFrame, rule: TwoState, length: str) -> DataFrame:
    """Per (series, window): rows, steps, both error sums and the weighted total, from a table of slices."""
    window = F.window("slice_start", length)
    placed = slices.withColumns({"window_start": window["start"], "window_end": window["end"]})
    order = Window.partitionBy("window_start", "sample_id").orderBy("slice_start")
    joined = placed.withColumn("d", F.abs(F.col("first") - F.lag("last").over(order)))
    between = {c: F.coalesce(F.sum(e(F.col("d"))), F.lit(0.0)) for c, e in (("moving", rule.moving_error), ("still", rule.static_error))}
    sums = joined.groupBy("window_start", "window_end", "sample_id").agg(
        F.sum("n").alias("n"), *[(F.sum(c) + b).alias(c) for c, b in between.items()]
    )
    # A window of one row has one step of size 0.
    still, moving = rule.errors_at_rest()
    single = F.col("n") == 1
    scored = sums.select(
        "window_start",
        "window_end",
        "sample_id",
        "n",
        F.greatest(F.col("n") - 1, F.lit(1)).alias("steps"),
        F.when(single, F.lit(moving)).otherwise(F.col("moving")).alias("moving"),
        F.when(single, F.lit(still)).otherwise(F.col("still")).alias("still"),
    )
    return scored.withColumn("total", F.least(F.lit(rule.alpha) * F.col("moving"), F.lit(rule.beta) * F.col("still")))


def total_score(scores: DataFrame, rule: TwoState, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """The metric from window scores."""
    return scores.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        F.sum("steps").alias("steps"),
        (F.sum("total") / F.sum("steps") * F.lit(float(rule.theta))).alias("loss_tgds"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    if not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def _expired(spark: SparkSession, path: str) -> Column:
    """The time before which slices have been expired, a null if none have."""
    marks = _stored(spark, path, "expired", "before TIMESTAMP").agg(F.max("before")).first()[0]
    return F.lit(marks).cast("timestamp")


def keep_slices(
    rows: DataFrame, path: str, checkpoint: str, rule: TwoState, value: str, length: str
) -> StreamingQuery:
    """Store the stream's rows by day below ``path/rows`` and a segment of each slice and series below ``path/segments``.

    Each trigger has folders of its own, which a repeated trigger replaces, and reads nothing but its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = with_slice(batch, length).select(*_SLICE, "ts", "event_id", F.col(value).alias("value"))
        placed = placed.withColumn("day", F.to_date("slice_start"))
        own = f"{path}/rows/batch={batch_id}"
        if _exists(spark, f"{path}/expired"):
            # the trigger's rows are read once from the stream, and twice from here
            arrived = f"{path}/arrived/batch={batch_id}"
            placed.write.mode("overwrite").parquet(arrived)
            placed = spark.read.schema(placed.schema).parquet(arrived)
            late = F.coalesce(F.col("slice_end") <= _expired(spark, path), F.lit(False))
            placed.where(late).drop("day").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            placed = placed.where(~late)
        placed.write.mode("overwrite").partitionBy("day").parquet(own)
        scored = slice_scores(spark.read.schema(_ROWS).option("basePath", f"{path}/rows").parquet(own), rule)
        scored.write.mode("overwrite").parquet(f"{path}/segments/batch={batch_id}")
        _delete(spark, f"{path}/arrived")

    return (
        rows.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _apart(spark: SparkSession, path: str, rule: TwoState) -> DataFrame:
    """Segments that don't overlap: overlapping ones are scored anew as one, from the stored rows between their bounds."""
    segments = _stored(spark, path, "segments", _SEGMENTS).drop("batch")
    order = Window.partitionBy("slice_start", "sample_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = segments.withColumn("_opens", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    grouped = opens.withColumn("_cluster", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_cluster = Window.partitionBy("slice_start", "sample_id", "_cluster")
    grouped = grouped.withColumns(
        {"_many": F.count("*").over(in_cluster), "_lo": F.min("lo").over(in_cluster), "_hi": F.max("hi").over(in_cluster)}
    )
    alone = grouped.where("_many = 1").drop("_opens", "_cluster", "_many", "_lo", "_hi")
    mixed = grouped.where("_many > 1").select("slice_start", "sample_id", "_cluster", "_lo", "_hi").distinct()
    mixed = mixed.withColumn("day", F.to_date("slice_start"))
    # days without such a stretch aren't read
    again = _stored(spark, path, "rows", _ROWS).join(mixed, ["day", "slice_start", "sample_id"])
    again = again.where(F.struct("ts", "event_id").between(F.col("_lo"), F.col("_hi")))
    again = again.withColumn("_cell", F.window("ts", CELL)["start"])
    keys = [*_SLICE, "_cluster"]
    rescored = merged(_scored(again, rule, "value", [*keys, "_cell"]), rule, keys)
    return alone.unionByName(rescored.drop("_cluster"))


def latest_slices(spark: SparkSession, path: str, rule: TwoState) -> DataFrame:
    """The score of each slice that ``keep_slices`` has stored rows of, from all of them."""
    return merged(_apart(spark, path, rule), rule, _SLICE).drop("lo", "hi")


def closed_slices(spark: SparkSession, path: str, rule: TwoState, delay: str | None) -> DataFrame:
    """The slices that ended at least ``delay`` before the newest row; all of them when the input has ended (no delay)."""
    slices = latest_slices(spark, path, rule)
    if delay is None:
        return slices
    newest = _stored(spark, path, "segments", _SEGMENTS).agg(F.max("newest")).scalar()
    return slices.where(F.col("slice_end") <= newest - F.expr(f"interval {delay}"))


def compact(spark: SparkSession, path: str, rule: TwoState) -> None:
    """Merge the segments stored so far into one of each slice. To be run while the stream stands still; a repeated run, also
    after one that was broken off, gives the same slices: what is merged is written aside first, then put in place.
    """
    slices = merged(_apart(spark, path, rule), rule, _SLICE)
    aside = f"{path}/merged"
    slices.write.mode("overwrite").parquet(aside)
    batches = [r[0] for r in _stored(spark, path, "segments", _SEGMENTS).select("batch").distinct().collect()]
    if not batches:
        return
    # one batch's folder takes all, the others go: a segment that is still there twice overlaps, and is scored from its rows
    whole = spark.read.parquet(aside)
    whole.write.mode("overwrite").parquet(f"{path}/segments/batch={max(batches)}")
    for batch in batches:
        if batch != max(batches):
            _delete(spark, f"{path}/segments/batch={batch}")
    _delete(spark, aside)


def expire(spark: SparkSession, path: str, rule: TwoState, delay: str) -> None:
    """Give up the rows of whole days that ended ``delay`` or more before the newest row: their slices are merged for good, and rows
    that come for them from now on count as late. To be run while the stream stands still."""
    newest = _stored(spark, path, "segments", _SEGMENTS).agg(F.max("newest")).scalar()
    limit = spark.range(1).select(F.date_trunc("day", newest - F.expr(f"interval {delay}"))).first()[0]
    if limit is None:
        return
    compact(spark, path, rule)
    spark.createDataFrame([(limit,)], "before TIMESTAMP").write.mode("append").parquet(f"{path}/expired")
    over = _stored(spark, path, "rows", _ROWS).groupBy("batch", "day").agg(F.max("slice_end").alias("end"))
    for row in over.where(F.col("end") <= F.lit(limit)).collect():  # a row for each folder
        _delete(spark, f"{path}/rows/batch={row['batch']}/day={row['day']}")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came for slices that had been expired."""
    return _stored(spark, path, "late", _ROWS.replace(", day DATE", ""))
