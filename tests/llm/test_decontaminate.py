from __future__ import annotations

import random

import numpy as np
from text_cases import ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import decontaminate
from tidetrace.llm.decontaminate import Rule


def score(item, words, match=2):
    """The best local alignment, cell by cell."""
    last, best = [0] * (len(words) + 1), 0
    for x in item:
        row = [0]
        for j, y in enumerate(words, 1):
            row.append(max(0, last[j - 1] + (match if x == y else -1), last[j] - 1, row[-1] - 1))
        best, last = max(best, *row), row
    return best


def test_align():
    draw = random.Random(1)
    for _ in range(300):
        a = np.array([draw.randrange(4) for _ in range(draw.randint(1, 12))], np.uint64)
        b = np.array([draw.randrange(4) for _ in range(draw.randint(0, 30))], np.uint64)
        assert decontaminate.align(a, b)[0] == score(a.tolist(), b.tolist())


VOCABULARY = [f"word{i}" for i in range(400)] + ["the", "of", "and", "é"] * 30


def corpus():
    draw = random.Random(5)
    items = [(i, [draw.choice(VOCABULARY) for _ in range(draw.randint(12, 50))]) for i in range(20)]
    items += [(20, ["the", "of"]), (21, []), (22, list(items[3][1]))]
    docs, held = [], set()
    for d in range(200):
        words = [draw.choice(VOCABULARY) for _ in range(draw.randint(0, 200))]
        if d % 4 == 0:
            i, item = items[draw.randrange(20)]
            copy = [w if draw.random() > 0.12 else draw.choice(VOCABULARY) for w in item if draw.random() > 0.03]
            at = draw.randint(0, len(words))
            words[at:at] = [w.upper() + draw.choice(["", ",", "."]) for w in copy]
            held.add((d, i))
        if d % 3 == 0:  # a passage that a third of all documents hold
            words += items[7][1]
            held.add((d, 7))
        docs.append((d, " ".join(words)))
    held |= {(d, 22) for d, i in held if i == 3}
    return docs, [(i, " ".join(w)) for i, w in items] + [(23, None)], held


def test_against_all_alignments(spark, tmp_path):
    docs, items, held = corpus()
    given = table(spark, docs, "doc_id long, text string", tmp_path / "d")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    norm = {i: (t or "").lower().split() for i, t in items}
    expected = {}
    for d, text in docs:
        words = text.lower().replace(",", "").replace(".", "").split()
        for i, item in norm.items():
            if len(item) >= 8 and (s := score(item, words) / (2 * len(item))) >= 0.4:
                expected[d, i] = s
    for rule in (Rule(), Rule(block_words=30)):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.find_passages(given, bench, rule).collect()}
        assert set(got) <= set(expected)
        assert all(got[p].score == expected[p] for p in got)
        missed = set(expected) - set(got)
        assert len(missed) <= 0.02 * len(expected)  # copies without four words in a row unchanged
        assert len(held & set(got)) >= 0.95 * len(held)
        # nothing but what was put there
        assert set(got) <= held


def test_span(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = table(spark, [(1, f"x y {item} z")], "doc_id long, text string", tmp_path)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find_passages(docs, bench).collect()] == [(1, 5, 1.0, 2, 11)]


def test_odd_rows(spark, tmp_path):
    docs = table(spark, ODD, SCHEMA, tmp_path / "a").withColumn("item_id", F.lit("clash"))
    bench = table(spark, [(1, ODD[0][1]), (None, ODD[0][1]), (2, None), (3, "")], "item_id long, text string", tmp_path / "i")
    found = decontaminate.find_passages(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) == sorted([("1", "1"), ("1", "None")] * 2 + [("None", "1"), ("None", "None")])
    assert decontaminate.find_passages(docs, bench.where("item_id > 1")).collect() == []
    assert decontaminate.find_passages(table(spark, [], SCHEMA, tmp_path / "b"), bench).collect() == []
