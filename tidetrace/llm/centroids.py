"""Cluster integer vectors around centroids with bounds that a history of centroids loosens (ns-bounds).

A vector keeps its distance to its centroid and to every other one as they were when last evaluated, each with the round of
that evaluation. The centroids of all rounds are kept, a few numbers each. In a later round a bound is loosened by the norm
of its centroid's whole displacement since its own evaluation, which is at most the sum of the drifts of the rounds between. Only
a vector whose loosened upper bound reaches a loosened lower one is looked at, and only centroids whose bound is reached are
evaluated again, exactly; so clusters are those of a full scan, ties included.

Sums of the vectors of a cluster are added up where they are read; a row per cluster comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm.common import written

#: Components beyond are taken as this: so far, squared distances of a few thousand components are exact in doubles.
LARGEST = 1 << 20
#: Bounds are compared with this relative slack, far above the rounding of a root.
_SLACK = 1e-9
_STATE = "cluster int, upper double, upper_round int, lower array<double>, lower_round array<int>"


def grid(embedding: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component as integers. Beyond ``LARGEST`` they are taken as that."""
    limit = float(LARGEST)
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("int")
    return F.transform(embedding, whole)


def usable(embedding: str, components: int) -> Column:
    """Whether a vector has exactly so many components and all of them are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(embedding) == components) & F.forall(embedding, finite), F.lit(False))


def drawn(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; null ids last, equal hashes by components. Fewer
    vectors than ``k`` give as many."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r.x for r in rows], np.int64)


@dataclass
class Bounds:
    """The bounds of some vectors, a row each; ``history`` has the centroids of every round so far."""

    x: np.ndarray
    cluster: np.ndarray
    upper: np.ndarray
    upper_round: np.ndarray
    lower: np.ndarray
    lower_round: np.ndarray

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray) -> Bounds:
        """All distances evaluated."""
        n, k = len(x), len(centroids)
        square = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids.astype(np.float64)], axis=1)
        cluster = square.argmin(axis=1)
        lower = np.sqrt(square)
        return cls(x, cluster, lower[np.arange(n), cluster], np.zeros(n, int), lower, np.zeros((n, k), int))

    def reassign(self, history: np.ndarray) -> int:
        """Move on to the last round of ``history``; the number of distances that were evaluated."""
        now, k = len(history) - 1, history.shape[1]
        centroids = history[now].astype(np.float64)
        moved = np.sqrt(((history - history[now]) ** 2).sum(axis=2))
        rows = np.arange(len(self.x))
        upper = self.upper + moved[self.upper_round, self.cluster]
        lower = self.lower - moved[self.lower_round, np.arange(k)]
        lower[rows, self.cluster] = np.inf
        lower -= _SLACK * (1 + np.abs(self.lower))
        failed = np.flatnonzero(upper >= lower.min(axis=1))
        # the distance to their own centroid first: for most it is enough
        own = self.cluster[failed]
        exact = ((self.x[failed] - centroids[own]) ** 2).sum(axis=1)
        self.upper[failed] = self.lower[failed, own] = np.sqrt(exact)
        self.upper_round[failed] = self.lower_round[failed, own] = now
        reached = self.upper[failed, None] >= lower[failed]
        still = reached.any(axis=1)
        failed, exact, reached, own = failed[still], exact[still], reached[still], own[still]
        at, j = np.nonzero(reached)
        square = np.full(reached.shape, np.inf)
        square[np.arange(len(failed)), own] = exact
        square[at, j] = ((self.x[failed[at]] - centroids[j]) ** 2).sum(axis=1)
        self.lower[failed[at], j] = np.sqrt(square[at, j])
        self.lower_round[failed[at], j] = now
        best = square.argmin(axis=1)  # the first of equal ones
        self.cluster[failed] = best
        self.upper[failed] = np.sqrt(square[np.arange(len(failed)), best])
        self.upper_round[failed] = now
        return int(len(still) + len(at))

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """The squared distances to the own centroid."""
        return ((self.x - centroids[self.cluster]) ** 2).sum(axis=1).astype(np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(kind)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), kind))


def _assigned(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state (vec_id, x and, after the first round, bounds) with the bounds of the last round of ``history``."""
    start = len(history) == 1
    schema = T.StructType([state.schema["vec_id"], state.schema["x"], *T._parse_datatype_string(_STATE).fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.float64)
            if start:
                bounds = Bounds.first(x, history[0])
            else:
                single = [np.array(batch.column(k)) for k in (2, 3, 4)]
                bounds = Bounds(x, *single, _matrix(batch.column(5), np.float64), _matrix(batch.column(6), np.int64))
                bounds.reassign(history)
            columns = [
                *batch.columns[:2],
                pa.array(bounds.cluster, pa.int32()),
                pa.array(bounds.upper),
                pa.array(bounds.upper_round, pa.int32()),
                _lists(bounds.lower, pa.float64()),
                _lists(bounds.lower_round, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return state.mapInArrow(assign, schema)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids, where a cluster has vectors their floored mean; exact sums, a row per cluster on the driver."""
    width = centroids.shape[1]
    sums = [F.sum(F.col("x")[i].cast("bigint")).alias(f"s{i}") for i in range(width)]
    found = state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, x, cluster, distance``, the final centroids) after ``rounds`` of assigning all vectors to their nearest centroid
    (the first of equally near ones) and moving each centroid to the floored mean of its vectors (if it has any), and a
    last assignment. ``vectors`` is (vec_id, x) with x arrays of integers, ``distance`` squared. Repeated vectors and null
    ids are rows like others. Without vectors there are no centroids, and the result is empty.
    """
    kind = T.StructType([vectors.schema["vec_id"], vectors.schema["x"], *T._parse_datatype_string("cluster int, distance long").fields])
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], kind), centroids
    history = centroids[None]
    state = written(_assigned(vectors, history), "state")
    for _ in range(rounds):
        history = np.concatenate([history, _means(state, history[-1])[None]])
        state = written(_assigned(state, history), "state")
    last = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.float64) if batch.num_rows else np.zeros((0, last.shape[1]))
            own = last[np.array(batch.column(2), dtype=np.int64)]
            far = pa.array(((x - own) ** 2).sum(axis=1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, far], kind.names)

    return state.select("vec_id", "x", "cluster").mapInArrow(measure, kind), last


def summary(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` with the sums of distances over the cluster and over all, and the centroid's SHA-256 (its
    components in decimal, joined by commas). ``clustered`` is a written table."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    session = clustered.sparkSession
    hashed = session.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    sums = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(hashed, "cluster")
    total = clustered.agg(F.sum("distance").alias("inertia"))
    # a row per centroid
    joined = clustered.join(F.broadcast(sums.crossJoin(F.broadcast(total))), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
