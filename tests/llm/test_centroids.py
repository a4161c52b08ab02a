from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_cases import table

from tidetrace.llm import centroids
from tidetrace.llm.queries import QUERIES

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, width, k=16, rounds=3):
    """Lloyd's rounds in integers; ``rows`` of (vec_id, floats)."""
    kept = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    means = [list(x) for _, x in order[:k]]

    def assign():
        out = []
        for _, x in kept:
            far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in means]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        of = assign()
        for j in range(len(means)):
            own = [x for (_, x), (c, _) in zip(kept, of) if c == j]
            if own:
                means[j] = [sum(col) // len(own) for col in zip(*own)]
    of = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return [(i, c, d, sum(e for b, e in of if b == c), sum(e for _, e in of), sha[c]) for (i, _), (c, d) in zip(kept, of)]


def clustered(docs, width, k=16, rounds=3):
    vectors = docs.where(centroids.usable("embedding", width)).select("vec_id", centroids.grid("embedding").alias("x"))
    found, last = centroids.cluster(vectors, centroids.drawn(vectors, k), rounds)
    return centroids.summary(found, last)


def same(got, expected):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_query_against_brute(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    expected = brute(rows, 64)
    same(QUERIES["op13_centroids"](spark, "/root/testdata/sf0.01"), expected)
    assert len({r[1] for r in expected}) > 10


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_ties(spark, tmp_path, rounds):
    """Few different vectors on a coarse grid: equal distances, empty clusters, repeated rows."""
    draw = random.Random(rounds)
    rows = [(i % 150, [draw.randint(-2, 2) / 64 for _ in range(3)]) for i in range(200)]
    rows += rows[:20]
    docs = table(spark, rows, "vec_id long, embedding array<float>", tmp_path)
    same(clustered(docs, 3, 9, rounds), brute(rows, 3, 9, rounds))


def test_bounds_save_work():
    """Clusters of a full scan from a fraction of its distances."""
    draw = np.random.default_rng(3)
    middle = draw.normal(0, 100, (12, 8))
    x = np.floor(middle[draw.integers(0, 12, 3000)] + draw.normal(0, 12, (3000, 8)))
    history = x[:12][None].astype(np.int64)
    bounds = centroids.Bounds.first(x, history[0])
    evaluated = 0
    for _ in range(8):
        new = history[-1].copy()
        for j in range(12):
            if (bounds.cluster == j).any():
                new[j] = np.floor(x[bounds.cluster == j].mean(axis=0))
        history = np.concatenate([history, new[None]])
        evaluated += bounds.reassign(history)
        square = ((x[:, None] - new[None]) ** 2).sum(axis=2)
        assert (bounds.cluster == square.argmin(axis=1)).all()
        assert (bounds.distances(new) == square.min(axis=1)).all()
    assert evaluated < 0.5 * 8 * 3000 * 12


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf])]
    rows += [(None, [3.0, -4.0]), (8, [0.1, 0.2, 0.3]), (9, [-0.01, 0.01])]
    docs = table(spark, rows, "vec_id long, embedding array<float>", tmp_path / "a").withColumn("x", F.lit("clash")).withColumn("cluster", F.lit(1))
    same(clustered(docs, 2), brute(rows, 2))
    far = table(spark, [(1, [1e30, -1e30]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>", tmp_path / "b")
    assert {r.vec_id: r.distance for r in clustered(far, 2, 1, 0).collect()}.keys() == {1, 2}
    assert clustered(table(spark, [], "vec_id long, embedding array<float>", tmp_path / "c"), 2).collect() == []
