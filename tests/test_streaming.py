from __future__ import annotations

import os
import shutil

import pytest
from series_cases import SMALL

from tidetrace.functions.physics import TwoState
from tidetrace.streaming import consistency as live

RULE = TwoState(20.0, 0.1, 2.0, 0.6)


@pytest.fixture(scope="module", params=["file", "folder", "parts"])
def arrivals(request, spark, tmp_path_factory):
    """The events as one file, a folder with one file, and a folder of six files that each hold all times."""
    folder = f"{tmp_path_factory.mktemp('in')}/events.parquet"
    if request.param == "file":
        shutil.copy(f"{SMALL}/events.parquet", folder)
        return folder
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    if request.param == "folder":
        events.coalesce(1).write.parquet(folder)
    else:
        for i in (3, 0, 5, 1, 4, 2):
            events.where(f"event_id % 6 = {i}").coalesce(1).write.mode("append").parquet(folder)
    return folder


def table(df):
    return sorted(tuple(r) for r in df.select("window_start", "sample_id", "n", "steps", "moving", "still", "total").collect())


def whole(spark):
    events = spark.read.schema(live.EVENT_SCHEMA).parquet(f"{SMALL}/events.parquet").selectExpr(
        "user_id as sample_id", "cast(ts as timestamp) as ts", "event_id", "cast(get_json_object(props, '$.k') as double) as value"
    )
    return live.slice_scores(live.with_slice(events, "1 day"), RULE)


@pytest.mark.parametrize(("length", "files"), [("3 hours", 1000), ("1 day", 1), ("6 hours", 2)])
def test_stream_equals_batch(spark, arrivals, tmp_path, length, files):
    """No row is lost, whatever the files and the rows' order."""
    stream = live.read_event_stream(spark, arrivals, files_per_trigger=files)
    live.keep_slices(stream, f"{tmp_path}/out", f"{tmp_path}/state", RULE, "el_power", length).awaitTermination()
    kept = live.window_scores(live.latest_slices(spark, f"{tmp_path}/out", RULE), RULE, "1 day")
    expected = table(live.window_scores(whole(spark), RULE, "1 day"))
    got = table(kept)
    assert len(expected) > 300 and sum(r[2] for r in got) == 1000 and [r[:4] for r in got] == [r[:4] for r in expected]
    assert [r[4:] for r in got] == [pytest.approx(r[4:]) for r in expected]
    total = live.total_score(kept, RULE, ()).first()
    assert total["loss_tgds"] == pytest.approx(2.0 * sum(r[6] for r in expected) / sum(r[3] for r in expected))


def test_closed_slices(spark, arrivals, tmp_path):
    """With a delay, only slices that ended that long before the newest row; without, all."""
    stream = live.read_event_stream(spark, arrivals, files_per_trigger=1)
    live.keep_slices(stream, f"{tmp_path}/out", f"{tmp_path}/state", RULE, "el_power", "1 day").awaitTermination()
    every = live.closed_slices(spark, f"{tmp_path}/out", RULE, None)
    closed = live.closed_slices(spark, f"{tmp_path}/out", RULE, "2 days")
    assert every.selectExpr("sum(n)").first()[0] == 1000
    late = every.join(closed, ["slice_start", "sample_id"], "left_anti")
    assert 0 < late.count() < every.count()
    newest = every.selectExpr("max(newest) - interval 2 days").first()[0]
    assert late.selectExpr("min(slice_end)").first()[0] > newest >= closed.selectExpr("max(slice_end)").first()[0]


@pytest.fixture(scope="module")
def hourly(spark, tmp_path_factory):
    """50 files in order of time."""
    folder = tmp_path_factory.mktemp("hourly")
    rows = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts", "event_id").toPandas()
    rows["ts"] = rows["ts"].astype("datetime64[us]")
    for k in range(50):
        rows.iloc[k * len(rows) // 50 : (k + 1) * len(rows) // 50].to_parquet(f"{folder}/{k:03}.parquet", index=False)
        os.utime(f"{folder}/{k:03}.parquet", (1_000_000 + k, 1_000_000 + k))
    return str(folder)


def stream(spark, folder, out, tmp_path, name):
    rows = live.read_event_stream(spark, folder, files_per_trigger=1)
    live.keep_slices(rows, out, f"{tmp_path}/{name}", RULE, "el_power", "1 day").awaitTermination()


def test_triggers_read_their_own_rows(spark, hourly, tmp_path):
    """After 50 triggers in order of time no stored row has been read again, and none is needed for the result."""
    out = f"{tmp_path}/out"
    stream(spark, hourly, out, tmp_path, "state")
    segments = spark.read.parquet(f"{out}/segments")
    assert segments.select("batch").distinct().count() == 50
    # as many segments in all as the triggers have slices with rows
    rows = spark.read.parquet(f"{out}/rows")
    assert segments.count() == rows.select("batch", "slice_start", "sample_id").distinct().count()
    assert segments.selectExpr("sum(n)").first()[0] == 1000
    shutil.rmtree(f"{out}/rows")
    expected = table(live.window_scores(whole(spark), RULE, "1 day"))
    got = table(live.window_scores(live.latest_slices(spark, out, RULE), RULE, "1 day"))
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert [r[4:] for r in got] == [pytest.approx(r[4:]) for r in expected]


def test_compact_expire_and_late_rows(spark, tmp_path):
    """Merging segments changes no score, before or after more rows; expired slices keep theirs, and rows for them are late."""
    out = f"{tmp_path}/out"
    first, second = f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.where("event_id % 3 > 0").coalesce(1).write.parquet(first)
    events.where("event_id % 3 = 0").coalesce(1).write.parquet(second)
    stream(spark, first, out, tmp_path, "one")
    before = table(live.window_scores(live.latest_slices(spark, out, RULE), RULE, "1 day"))
    live.compact(spark, out, RULE)
    live.compact(spark, out, RULE)
    assert table(live.window_scores(live.latest_slices(spark, out, RULE), RULE, "1 day")) == before
    # batch 0 again would replace the rows, so the second part has a store of its own that is put beside
    other = f"{tmp_path}/other"
    stream(spark, second, other, tmp_path, "two")
    for name in ("rows", "segments"):
        shutil.move(f"{other}/{name}/batch=0", f"{out}/{name}/batch=7")
    expected = table(live.window_scores(whole(spark), RULE, "1 day"))
    got = table(live.window_scores(live.latest_slices(spark, out, RULE), RULE, "1 day"))
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert [r[4:] for r in got] == [pytest.approx(r[4:]) for r in expected]
    live.expire(spark, out, RULE, "3 days")
    limit = spark.read.parquet(f"{out}/expired").first()[0]
    left = spark.read.parquet(f"{out}/rows").selectExpr("min(slice_end)").first()[0]
    assert left > limit
    again = table(live.window_scores(live.latest_slices(spark, out, RULE), RULE, "1 day"))
    assert [r[:4] for r in again] == [r[:4] for r in expected]
    assert [r[4:] for r in again] == [pytest.approx(r[4:]) for r in expected]
    assert live.late_rows(spark, out).count() == 0
    stream(spark, second, out, tmp_path, "three")
    late = live.late_rows(spark, out)
    assert 0 < late.count() < 1000 and late.selectExpr("max(slice_end)").first()[0] <= limit


def test_hot_series(spark):
    """One series with most rows is scored in cells, and the cells give what one pass gives."""
    rows = spark.range(20_000).selectExpr(
        "0L as sample_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 3) as ts", "id as event_id",
        "cast(if(id % 97 = 0, null, pmod(id * id, 41)) as double) as value",
    )
    placed = live.with_slice(rows, "1 day")
    fine, whole = (live.slice_scores(placed, RULE, cell=c).collect() for c in ("1 minute", "1 day"))
    assert len(fine) == len(whole) == 1
    for name in fine[0].__fields__:
        assert fine[0][name] == (pytest.approx(whole[0][name]) if name in ("moving", "still") else whole[0][name])
