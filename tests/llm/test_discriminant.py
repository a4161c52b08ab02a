from __future__ import annotations

import zlib

import numpy as np
import pytest
from text_cases import ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import discriminant
from tidetrace.llm.discriminant import FEATURES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    scored = discriminant.quality(discriminant.with_features(docs).cache(), labels)
    rows = scored.join(labels.select("doc_id", "quality").distinct(), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.quality, r.predicted) for r in rows if r.held_out]
    assert len(held) > 50 and sum(q == p for _, q, p in held) >= 0.95 * len(held)
    good, bad = ([s for s, q, _ in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_fit_is_the_formula(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, len(FEATURES))) * np.linspace(0.5, 2, len(FEATURES))
    y = (draw.random(300) < 0.7).astype(int)
    x[y == 1] += 0.4
    model = discriminant.fit(spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(y, x)], "label int, x array<double>"), shrink=0.2, scale=1)
    logs = []
    pooled = sum((y == k).sum() * np.diag(x[y == k].var(axis=0)) for k in (0, 1)) / 300 + 1e-4 * np.eye(len(FEATURES))
    for k in (0, 1):
        part = x[y == k]
        cov = 0.8 * np.cov(part.T, bias=True) + 0.2 * pooled
        off = x - part.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(part)))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_few_labels(spark, tmp_path):
    measured = discriminant.with_features(table(spark, ODD, SCHEMA, tmp_path).withColumn("x", F.lit("clash")))
    for rows in ([], [(1, 1, 0), (6, 1, 0), (None, 0, 0), (2, None, 1), (3, 7, 0)]):
        got = discriminant.quality(measured, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == len(ODD) and len({r.score for r in got}) == 1 and all(0 < r.score < 1 for r in got)
        assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_every_text_has_finite_features(spark, tmp_path):
    for text in (None, "", " \n\t", "\x0b", "a", "|" * 50, "é", "\U0001f600", ODD[6][1]):
        assert len(discriminant.features(text)) == len(FEATURES) and np.isfinite(discriminant.features(text)).all()
    empty = discriminant.with_features(table(spark, [], SCHEMA, tmp_path))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert discriminant.quality(empty, labels).collect() == []
