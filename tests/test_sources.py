from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidetrace.functions.physics import TwoState
from tidetrace.operators.consistency import metric_of, metric_state, tgds_metric
from tidetrace.functions.text import json_merge, parse_duration, path_tail, series_number
from tidetrace.sources import results, signals
from tidetrace.plans.layout import Layout


def test_series_files(spark, tmp_path):
    for number, (start, extra) in {4: (810, "spinning_soll"), 22: (0, "spinning_ist")}.items():
        lines = [f"time|input_voltage|el_power|th_power|{extra}"] + [f"{start + i}|{i}.5|{i * 10}.25|1|2" for i in range(3)]
        (tmp_path / f"experiment_{number}_short.csv").write_text("\n".join(lines) + "\n")
    paths = {"spinning_soll": [f"{tmp_path}/experiment_4_short.csv"], "spinning_ist": [f"{tmp_path}/experiment_22_short.csv"]}
    got = signals.read_experiments(spark, paths)
    assert got.columns == ["sample_id", "time", "input_voltage", "el_power"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (s, start + i, i + 0.5, i * 10 + 0.25) for s, start in ((4, 810), (22, 0)) for i in range(3)
    ]


@pytest.mark.parametrize("sent", [0, 100])
def test_headers_that_drift(spark, tmp_path, monkeypatch, sent):
    """Each file is read by its own header: other columns, another order, blanks, a header alone, no line at all."""
    monkeypatch.setattr(signals, "SENT_FILES", sent)
    texts = {
        "experiment_4_short.csv": "time|input_voltage|el_power|th_power|spinning_soll\n0|1.5|2.5|9|9\n1|1.75||9|9\n",
        "deep/experiment_22_short.csv": "spinning_ist|el_power|time| input_voltage \n9|3.5|7|4.5\n9|x|8| 5.5\n",
        "experiment_9_short.csv": "time|el_power\n3|0.5\n",
        "experiment_20_short.csv": "time|input_voltage|el_power\n",
        "experiment_21_short.csv": "",
    }
    (tmp_path / "deep").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = signals.read_by_header(spark, str(tmp_path), "time BIGINT, input_voltage DOUBLE, el_power DOUBLE", glob="*.csv")
    assert got.columns == ["sample_id", "time", "input_voltage", "el_power"]
    expected = [(4, 0, 1.5, 2.5), (4, 1, 1.75, None), (22, 7, 4.5, 3.5), (22, 8, 5.5, None), (9, 3, None, 0.5)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_header_of_a_file_in_many_splits(spark, tmp_path):
    """Only the first line of a file is its header, wherever splits begin."""
    lines = "".join(f"{i}|{i}.5\n" for i in range(60_000))
    (tmp_path / "sample_1.csv").write_text("time|el_power\n" + lines)
    (tmp_path / "sample_2.csv").write_text("el_power|time\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        got = signals.read_by_header(spark, str(tmp_path), "time DOUBLE, el_power DOUBLE")
        assert got.rdd.getNumPartitions() > 10
        sums = {r[0]: r[1:] for r in got.groupBy("sample_id").agg(F.count("*"), F.sum("time"), F.sum("el_power")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = 60_000 * 59_999 / 2
    assert sums == {1: (60_000, whole, whole + 30_000), 2: (60_000, whole + 30_000, whole)}


def test_metric_by_day(spark, tmp_path):
    """Stored halves give what one run gives; a day that is stored again replaces itself; a reset moves the first day."""
    rule = TwoState(steepness=0.5, tolerance=0.1, theta=10.0, ratio=0.6)
    rows = [(b // 3, b, i, float(b * i % 7), abs(b - i) / 3 if i else None) for b in range(9) for i in range(5)]
    steps = spark.createDataFrame(rows, "day bigint, batch_no bigint, row_no bigint, y_pred double, d double")
    state = lambda where: metric_state(steps.where(where), rule, ("day", "batch_no"), ("day",))
    path = f"{tmp_path}/metric"
    schema = state("true").schema
    read = lambda since=None: tuple(metric_of(results.read_metric(spark, path, schema, since), rule).first())
    assert read() == (0.0, 0, 0.0)
    for where in ("day = 0", "day > 0", "day = 1"):
        results.store_metric(state(where), path, "day")
    assert read() == pytest.approx(tuple(tgds_metric(steps, rule).first()))
    assert read(F.col("day") >= 2) == pytest.approx(tuple(tgds_metric(steps.where("day = 2"), rule).first()))


def test_series_of_the_synthetic_kind(spark, tmp_path):
    for i in (0, 2, 10):
        (tmp_path / f"sample_{i}.csv").write_text(f"el_power|time|input_voltage\n{i}.5|0|1.0\n")
    (tmp_path / "info.json").write_text(json.dumps({"input_range": [-1, 10], "output_range": [-1, 4000], "max_lag": 7}, indent=4))
    columns = "el_power DOUBLE, time BIGINT, input_voltage DOUBLE"
    got = signals.read_signals(spark, str(tmp_path), columns, glob="sample_*.csv")
    assert sorted((r["sample_id"], r["el_power"]) for r in got.collect()) == [(0, 0.5), (2, 2.5), (10, 10.5)]
    info = signals.read_info(spark, f"{tmp_path}/info.json").first()
    assert list(info["output_range"]) == [-1.0, 4000.0] and info["max_lag"] == 7


def test_write_signals(spark, tmp_path):
    rows = [(s, t, float(t), float(s)) for s in (3, 12, 1500) for t in range(9)]
    df = spark.createDataFrame(rows, "sample_id bigint, time bigint, input_voltage double, el_power double")
    columns = "time BIGINT, input_voltage DOUBLE, el_power DOUBLE"
    signals.write_signals(df, f"{tmp_path}/one", series_per_folder=1, layout=Layout(chunk=4))
    signals.write_signals(df, f"{tmp_path}/many")
    one = signals.read_signals(spark, f"{tmp_path}/one", columns)
    many = signals.read_signals(spark, f"{tmp_path}/many", "sample_id BIGINT, " + columns)
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in many.collect()) == rows
    assert sorted(p.name for p in (tmp_path / "one").glob("sample_id=*")) == ["sample_id=12", "sample_id=1500", "sample_id=3"]


def test_config_is_written_once_per_run(spark, tmp_path):
    def frame(*rows):
        return spark.createDataFrame(rows, "folder bigint, seed bigint")

    for df in (frame((1, 1)), frame((1, 2), (2, 2)), frame((3, 3), (2, 9))):
        signals.write_config(df, f"{tmp_path}/config")
        signals.write_result(df.limit(1), f"{tmp_path}/result")
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/config").collect()) == [(1, 1), (2, 2), (3, 3)]
    assert spark.read.json(f"{tmp_path}/result").count() == 1


def test_result_tree_with_a_folder_of_lines(spark, tmp_path):
    """Every line of a folder that Spark wrote is a config; an indented file is one."""
    rows = [(i, f"loss{i}") for i in range(3)]
    spark.createDataFrame(rows, "seed bigint, loss_function string").coalesce(1).write.json(f"{tmp_path}/a/config.json")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "config.json").write_text(json.dumps({"seed": 7, "loss_function": "x", "train_samples": ["1"]}, indent=2))
    got = results.read_json_tree(spark, str(tmp_path), "config.json", signals.CONFIG_SCHEMA)
    found = sorted((r.folder, r.seed, r.loss_function, r.train_samples) for r in got.collect())
    assert found == [("a/", i, f"loss{i}", None) for i in range(3)] + [("b/", 7, "x", ["1"])]


def test_result_tree_at_any_depth(spark, tmp_path):
    def put(folder, **files):
        (tmp_path / folder).mkdir(parents=True)
        for name, content in files.items():
            (tmp_path / folder / f"{name}.json").write_text(json.dumps(content, indent=4))

    config = {"loss_function": "mse", "n_train_samples": 4, "train_samples": ["1", "9"], "lambda": 0.5}
    put("a/b/run1", config=config, result={"test_rmse_mean": 1.5, "best_epoch": 3})
    put("a/run2", config=config | {"loss_function": "two"}, result={"test_rmse_mean": 2.5})
    put("a/run3", config=config)
    put("a/run4", result={"test_rmse_mean": 9.0})
    got = results.scan_results(spark, str(tmp_path)).select("folder", "loss_function", "test_rmse_mean", "best_epoch")
    assert sorted(tuple(r) for r in got.collect()) == [("a/b/run1/", "mse", 1.5, 3), ("a/run2/", "two", 2.5, None)]


def test_text_functions(spark):
    texts = ["1 day, 2:03:04.500000", "-1 day, 23:59:59", "12 days, 0:00:00", "0:00:01.25", "soon", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_duration(F.col("t"))).collect()] == [93784.5, -1.0, 1036800.0, 1.25, None, None]
    paths = ["Data/x_1/sample_12.csv", "a/experiment_4_short.csv", "r/sample_id=7/part-00000-3_2.csv", "none.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(F.coalesce(series_number(F.col("p")), F.lit(-1)), path_tail(F.col("p"))).collect()
    assert [r[1] for r in got[:3]] == ["x_1/", "/", "sample_id=7/"]
    assert [r[0] for r in got[:2]] == [12, 4]


def test_json_merge(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b": 2, "c": null}')], "l string, r string")
    assert df.select(json_merge(F.col("l"), F.col("r"))).first()[0] == {"a": "1", "b": "2", "c": None}
