from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from text_cases import ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import fair_queue


def targets(sizes, weights=(5, 2, 1), passes=3):
    """Share by weight, cap, share what is left over again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] > passes * sizes[s] * whole]
        if not above:
            return out | {s: left * weight[s] / whole for s in free}
        for s in above:
            out[s] = passes * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def mix(docs, weights=(5, 2, 1), passes=3, seed=7):
    """(doc_id, size, source) -> words taken, by one sort."""
    sizes = defaultdict(int)
    for _, source, size in docs:
        sizes[source] += size
    goal, queue = targets(sizes, weights, passes), []

    def turn(doc):
        parts = [str(x) for x in (seed, doc[0], doc[2]) if x is not None]
        return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:12], 16), doc[0] is not None, doc[0] or 0, doc[2]

    for source in sizes:
        upto = 0
        for place, doc in enumerate(sorted((d for d in docs if d[1] == source), key=turn)):
            upto += doc[2]
            for n in range(passes):
                finish = (n * sizes[source] + upto) / goal[source] if goal[source] else 0.0
                queue.append((finish, "" if source is None else f"={source}", n, place, doc))
    position, taken = 0, defaultdict(int)
    for _, line, n, place, doc in sorted(queue, key=lambda q: q[:4]):
        position += doc[2]
        taken[line, place, doc] += doc[2] if position <= sum(sizes.values()) else 0
    return sorted(((d[0] is not None, d[0] or 0, d[2], t) for (_, _, d), t in taken.items())), goal


DOCS = [(i, f"s{i % 7 if i % 3 else 0}", (i * 37) % 90) for i in range(400)] + [(i, None, 5) for i in range(400, 410)]


@pytest.mark.parametrize("rows", [50_000, 16])
def test_mix(spark, rows, monkeypatch, tmp_path):
    """The same mix whatever the size of a range; repeats, null sources and sizes of 0 included."""
    monkeypatch.setattr(fair_queue, "RANGE_ROWS", rows)
    docs = table(spark, DOCS, "doc_id long, source string, size long", tmp_path)
    got = fair_queue.mix(docs).collect()
    expected, goal = mix(DOCS)
    assert sorted((r.doc_id is not None, r.doc_id, r["size"], r.taken) for r in got) == expected
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in goal.values()})
    assert all(r.taken <= 3 * r["size"] for r in got)
    for source, target in goal.items():
        words = sum(r.taken for r, in zip(got) if dict((d[0], d[1]) for d in DOCS)[r.doc_id] == source)
        assert abs(words - target) <= 2 * 90


def test_small_sources_are_capped(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 100), (None, 7)]
    got = {r.source: r.target for r in fair_queue.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    expected = targets(dict(sizes))
    assert got == pytest.approx(expected)
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(1117)


def test_queue_order(spark, tmp_path):
    docs = table(spark, DOCS, "doc_id long, source string, size long", tmp_path)
    rows = fair_queue.fair_queue(docs).where("size > 0").orderBy("position").collect()
    assert [r.position for r in rows] == list(__import__("itertools").accumulate(r["size"] for r in rows))
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)


def test_odd_rows(spark, tmp_path):
    docs = table(spark, ODD, SCHEMA, tmp_path / "a").withColumn("size", F.lit("clash"))
    rows = fair_queue.mix(fair_queue.sized(docs)).collect()
    assert len(rows) == len(ODD)
    assert {r["size"] for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert fair_queue.mix(fair_queue.sized(table(spark, [], SCHEMA, tmp_path / "b"))).collect() == []
    silent = table(spark, [(1, "", "en", "a", 0), (2, None, None, None, None)], SCHEMA, tmp_path / "c")
    assert {(r.taken, r.target) for r in fair_queue.mix(fair_queue.sized(silent)).collect()} == {(0, 0.0)}


def test_equal_rows_spread_over_ranges(spark, monkeypatch):
    """Rows that are alike in all columns, and rows without words, don't meet in one range."""
    monkeypatch.setattr(fair_queue, "RANGE_ROWS", 500)
    nulls = spark.range(10_000).selectExpr("cast(null as bigint) as doc_id", "if(id % 2 = 0, 'a', 'b') as source", "5L as size")
    empty = spark.range(10_000).selectExpr("id as doc_id", "if(id < 5000, 'a', 'z') as source", "0L as size")
    docs = nulls.union(empty).union(empty.where("doc_id < 3").selectExpr("doc_id", "'b'", "7L"))
    queue = fair_queue.queued(docs, (5, 2, 1), 1.0, 3, 7)
    largest = queue.groupBy("step").count().agg(F.max("count")).first()[0]
    assert largest < 2000
    got = fair_queue.mix(docs).groupBy("source_size", "size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    rows = [(None, "ab"[i % 2], 5) for i in range(10_000)] + [(i, "a" if i < 5000 else "z", 0) for i in range(10_000)]
    rows += [(i, "b", 7) for i in range(3)]
    expected, _ = mix(rows)
    assert sum(r.n for r in got) == len(rows)
    assert sum(r.taken for r in got) == sum(t for *_, t in expected)
    assert {(r["size"]): r.taken for r in got if r["size"] == 7} == {7: sum(t for _, _, n, t in expected if n == 7)}
