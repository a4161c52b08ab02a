from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetrace.functions.physics import TwoState
from tidetrace.operators import consistency
from tidetrace.operators.consistency import abs_differences, batch_blocks, tgds_loss_by_batch, tgds_metric, tgds_sweep


def steps_of(spark, y_true, y_pred, batch=None):
    batch = batch or [0] * len(y_pred)
    rows = [(b, i, float(y), float(p)) for i, (b, y, p) in enumerate(zip(batch, y_true, y_pred))]
    return abs_differences(spark.createDataFrame(rows, "batch_no bigint, row_no bigint, y_true double, y_pred double"))


GOLDENS = [
    ([1, 1, 1, 1], TwoState(1, 0, 1, 1), dict(mse=0, static=0, trans=1, tgds=0, loss=0)),
    ([0, 1, 2, 3], TwoState(1, 0, 1, 1), dict(mse=0, static=1, trans=0, tgds=0, loss=0)),
    ([0, 0.5, 1], TwoState(1, 0, 2, 1), dict(static=0.25, trans=0.25, tgds=0.125, loss=0.25)),
    ([0, 0.25, 0.5], TwoState(1, 0, 1, 3), dict(static=0.0625, trans=0.5625, tgds=0.046875, loss=0.046875)),
    ([5], TwoState(2, 0.5, 1, 1), dict(static=0, trans=1, loss=0)),
]


@pytest.mark.parametrize("values, rule, expected", GOLDENS)
def test_loss_goldens(spark, values, rule, expected):
    got = tgds_loss_by_batch(steps_of(spark, values, values), rule).first().asDict()
    assert {k: got[k] for k in expected} == pytest.approx(expected)


def test_metric_weighs_the_states_the_other_way(spark):
    got = tgds_metric(steps_of(spark, [0, 0.25, 0.5], [0, 0.25, 0.5]), TwoState(1, 0, 1, 3)).first()
    assert got["loss_tgds"] == pytest.approx(0.015625) and got["steps"] == 2


def test_metric_of_a_single_row_and_of_nothing(spark):
    one = tgds_metric(steps_of(spark, [5], [5]), TwoState(2, 0.5)).first()
    assert (one["steps"], one["loss_tgds"]) == (1, 0)
    none = tgds_metric(steps_of(spark, [5], [5]).where("false"), TwoState(2, 0.5)).first()
    assert (none["steps"], none["loss_tgds"]) == (0, 0)


def by_formula(y, p, rule):
    """Loss parts of one batch in NumPy."""
    d = np.abs(np.diff(p)) if len(p) > 1 else np.array([0.0])
    low, high = rule.steepness * (1 - rule.tolerance), rule.steepness * (1 + rule.tolerance)
    moving = np.where(d < low, low - d, np.where(d > high, d - high, 0)) ** 2
    still = np.maximum(d - rule.tolerance * rule.steepness, 0) ** 2
    mse, beta = np.mean((y - p) ** 2), 1 / (rule.ratio + 1)
    tgds = min((1 - beta) * still.mean(), beta * moving.mean())
    weight = 1 - rule.theta if rule.normalized else 1
    metric = min((1 - beta) * moving.sum(), beta * still.sum())
    return mse, tgds, weight * mse + rule.theta * tgds, metric, len(d)


RULES = [TwoState(0.3, t, th, r, n) for t in (0, 0.1, 0.5) for th, n in ((2.0, False), (0.4, True)) for r in (0.6, 3.0)]


def random_batches(spark):
    draw = np.random.default_rng(11)
    y, p = draw.random(41), draw.random(41)
    batch = [i // 8 for i in range(41)]
    return y, p, batch, steps_of(spark, y, p, batch)


def test_against_numpy(spark):
    y, p, batch, steps = random_batches(spark)
    for rule in RULES[::3]:
        parts = [by_formula(y[i : i + 8], p[i : i + 8], rule) for i in range(0, 41, 8)]
        got = tgds_loss_by_batch(steps, rule).orderBy("batch_no").collect()
        assert [(r["mse"], r["tgds"], r["loss"]) for r in got] == [pytest.approx(x[:3]) for x in parts]
        metric = tgds_metric(steps, rule).first()["loss_tgds"]
        assert metric == pytest.approx(rule.theta * sum(x[3] for x in parts) / sum(x[4] for x in parts))


def test_sweep_equals_single_losses(spark):
    y, p, batch, steps = random_batches(spark)
    got = {
        (r["theta"], r["tgds_ratio"], r["loss_tolerance"], r["normalized"]): r["loss"] for r in tgds_sweep(steps, RULES).collect()
    }
    assert len(got) == len(RULES)
    for rule in RULES:
        one = tgds_loss_by_batch(steps, rule).agg(F.sum(F.col("loss") * F.col("n")) / F.sum("n")).first()[0]
        assert got[(rule.theta, rule.ratio, rule.tolerance, rule.normalized)] == pytest.approx(one)


def test_wider_tolerance_never_raises_the_static_error(spark):
    *_, steps = random_batches(spark)
    means = [tgds_loss_by_batch(steps, TwoState(0.3, t)).agg(F.avg("static")).first()[0] for t in (0, 0.1, 0.3, 1.0)]
    assert means == sorted(means, reverse=True)


def test_first_row_of_a_batch_has_no_step(spark):
    *_, steps = random_batches(spark)
    assert steps.where("d is null").count() == 6


def test_refuses_crossed_bounds():
    with pytest.raises(ValueError):
        TwoState(-1.0, 0.1)


def test_batches_are_not_placed_by_one_task(spark):
    """What meets in one task are the totals of id blocks, and sums that each task has made."""
    df = spark.createDataFrame([(1, 0, 1.0)], "sample_id bigint, time bigint, y double")
    plan = batch_blocks(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    assert single
    for below in (plan[i + 1] for i in single):
        assert "HashAggregate(keys=[_block" in below or "Aggregate(keys=[], functions=[partial_" in below


@pytest.mark.parametrize("kind", ["sparse", "text"])
def test_batches_of_sparse_and_text_ids(spark, kind, monkeypatch):
    """Row numbers follow the order of ids of any kind, with several blocks of ids."""
    from tidetrace.operators import consistency

    monkeypatch.setattr(consistency, "ID_BLOCK", 3)
    ids = sorted((i * 0x9E3779B97F4A7C15) % (1 << 62) - (1 << 61) for i in range(1, 21))
    if kind == "text":
        ids = sorted(f"run-{i % 9973}" for i in ids)
    rows = [(s, t, 0.0) for k, s in enumerate(ids) for t in range(k % 4 + 1)]
    df = spark.createDataFrame(rows, f"sample_id {'string' if kind == 'text' else 'bigint'}, time bigint, y double")
    got = batch_blocks(df, 4).orderBy("row_no").collect()
    assert [(r.sample_id, r.time, r.row_no) for r in got] == [(s, t, i) for i, (s, t, _) in enumerate(rows)]


def test_blocks_of_any_ids(spark, monkeypatch):
    """Blocks of ids hold about as many ids, in order, also where ids share their beginning or one is far from all others."""
    monkeypatch.setattr(consistency, "ID_BLOCK", 100)
    for ids in ("format_string('sample_%06d', id)", "if(id = 999, 1L << 60, id)", "id * id * id", "if(id = 0, null, id)"):
        sizes = spark.range(1000).selectExpr(f"{ids} as sample_id", "id + 1 as length", "0 as first_tick")
        blocks = consistency.id_blocks(sizes, "sample_id").groupBy("_block")
        got = blocks.agg(F.count("*").alias("n"), F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")).orderBy("_block").collect()
        assert len(got) >= 8 and max(r.n for r in got) <= 200
        assert all(a.hi < b.lo for a, b in zip(got, got[1:]))
        placed = consistency.series_offsets(sizes).orderBy(F.col("sample_id").asc_nulls_first()).collect()
        expected = 0
        for r in placed:
            assert r.offset == expected
            expected += r.length
