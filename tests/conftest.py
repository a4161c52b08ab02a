from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """(rows as {sample_id: [values]}, DataFrame sample_id, time, y) with one long series and a few short ones."""
    import random

    draw = random.Random(5)
    values = {1: [draw.randint(0, 2) for _ in range(120)], 2: [draw.randint(0, 2) for _ in range(7)], 3: [1], 9: [0, 0, 2]}
    rows = [(k, t, float(v)) for k, vs in values.items() for t, v in enumerate(vs)]
    draw.shuffle(rows)
    return values, spark.createDataFrame(rows, "sample_id bigint, time bigint, y double").cache()
