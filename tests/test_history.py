from __future__ import annotations

import pytest
from series_cases import rows_of

from tidetrace.operators import history
from tidetrace.plans.layout import Layout

LAYOUTS = [Layout(("run_id",), "epoch", longest=0), Layout(("run_id",), "epoch", chunk=2)]
RUNS = {
    "tie": [0.5, 0.3, 0.3],
    "flat": [3.0, 2.0, 2.0, 2.0, 2.0],
    "late": [5.0, 6.0, 4.0, 7.0, 3.0, 3.0, 9.0],
    "nan": [float("nan"), 1.0, float("nan"), 0.5],
    "never": [float("nan"), float("inf"), float("nan")],
}


def table(spark):
    rows = [(run, e + 1, v) for run, values in RUNS.items() for e, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, epoch bigint, val_loss double")


def test_best_epoch(spark):
    got = {r["run_id"]: r["best_epoch"] for r in history.best_epoch(table(spark)).collect()}
    assert {k: got[k] for k in ("tie", "flat", "late", "nan")} == {"tie": 2, "flat": 2, "late": 5, "nan": 4}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_checkpoints(spark, layout):
    got = rows_of(history.checkpoint_epochs(table(spark), layout), "run_id", "epoch")
    assert got == [
        ("flat", 1), ("flat", 2), ("late", 1), ("late", 3), ("late", 5), ("nan", 2), ("nan", 4), ("tie", 1), ("tie", 2),
    ]


def stop_by_loop(values, patience):
    best, wait = float("inf"), 0
    for epoch, value in enumerate(values, 1):
        wait += 1
        if value < best:
            best, wait = value, 0
        if wait >= patience:
            return epoch
    return None


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stop(spark, layout, patience):
    got = {r["run_id"]: r["stop_epoch"] for r in history.early_stop_epoch(table(spark), patience, layout).collect()}
    assert got == {run: stop_by_loop(values, patience) for run, values in RUNS.items()}


def test_patience():
    assert history.patience_for(300) == 90 and history.patience_for(25) == 7


@pytest.mark.parametrize("chunk", [2, 100])
def test_running_batch_loss(spark, chunk):
    rows = [(1, e, b, float(b + e), 128 if b < 4 else 17) for e in range(2) for b in range(5)]
    df = spark.createDataFrame(rows, "run_id bigint, epoch bigint, batch bigint, loss double, n bigint")
    layout = Layout(("run_id", "epoch"), "batch", chunk=chunk)
    got = {(r["epoch"], r["batch"]): r["running_loss"] for r in history.running_batch_loss(df, layout).collect()}
    assert got[(1, 0)] == 1.0 and got[(0, 3)] == pytest.approx(1.5)
    assert got[(0, 4)] == pytest.approx((128 * 6 + 17 * 4) / (4 * 128 + 17))


def test_first_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, 0, 1.0), (1, 1, 5, nan), (1, 1, 2, -inf), (2, 0, 0, 1.0), (3, 0, 1, nan), (3, 2, 0, nan)]
    df = spark.createDataFrame(rows, "run_id bigint, epoch bigint, batch bigint, loss double")
    got = rows_of(history.first_nan_batch(df), "run_id", "nan_epoch", "nan_batch")
    assert got == [(1, 1, 2), (2, None, None), (3, 0, 1)]
