"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import partial

import duckdb
import pytest
from series_cases import SMALL

import __spark_entry__ as entry_point
from tidetrace.plans import views
from tidetrace.plans.queries import QUERIES

TABLES = "customer orders events".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def compare(spark, sql, name):
    df = entry_point.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = sql.execute(entry_point.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = [list(types).index(c) if c in types else None for c in columns]
    assert sorted(types) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    expected = sorted(tuple(text(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    compare(spark, sql, name)


CHUNKED = (
    "align_xy", "batch_blocks", "checkpoint_epochs", "early_stop_epoch", "expected_response", "fit_tgds_linear",
    "forward_diff", "lag_array", "lag_features", "response_residuals", "run_lists", "scan_signals", "segment_stats",
    "static_segments", "step_fill", "tail_split", "tgds_loss_by_batch", "tgds_loss_by_sample", "tgds_metric", "value_runs",
)


@pytest.mark.parametrize("name", CHUNKED)
def test_query_with_long_series(spark, sql, name, monkeypatch):
    """The same rows when every series is longer than a chunk."""
    monkeypatch.setattr(views, "SIGNALS", replace(views.SIGNALS, chunk=16))
    monkeypatch.setattr(views, "EPOCHS", replace(views.EPOCHS, chunk=16))
    monkeypatch.setattr(views, "ordinals", partial(views.ordinals, chunk=16))
    compare(spark, sql, name)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 15


def plan(spark, name):
    return entry_point.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_lag_columns_share_one_window_and_shuffle(spark):
    text = plan(spark, "lag_features")
    assert text.count("Exchange") == 1
    assert sum("Window [lag(" in line for line in text.splitlines()) == 1


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "sample_lengths")
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_segments_need_one_shuffle_of_the_rows(spark):
    assert plan(spark, "static_segments").count("Exchange") == 1


def test_filter_on_the_series_reaches_the_scan(spark):
    from tidetrace.operators.features import lag_features
    from tidetrace.plans import views

    rows, layout = views.signals(spark, SMALL)
    lagged = lag_features(rows, ["el_power"], 3, 1, layout).where("sample_id = 4")
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,4)]" in lagged._jdf.queryExecution().executedPlan().toString()
