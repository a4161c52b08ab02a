from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_cases import ODD, SCHEMA, table

from tidetrace.llm import backoff
from tidetrace.llm.backoff import Model

BEGIN, END = object(), object()


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def learned(texts, model):
    """(count, tokens, chance) of the texts: the formulas with dictionaries."""
    count, tokens = Counter(), Counter()
    for text in texts:
        row = (BEGIN, *words(text), END)
        tokens.update(row[1:])
        for k in range(1, model.order + 1):
            count.update(row[i : i + k] for i in range(len(row) - k + 1))
    n, v, m = sum(tokens.values()), len(tokens), model.strength

    def chance(gram):
        if len(gram) == 1:
            return (tokens[gram[0]] + 1) / (n + v + 1)
        return (count[gram] + m * chance(gram[1:])) / (count[gram[:-1]] + m)

    return count, tokens, chance


def brute(rows, model):
    """An automaton of dictionaries, walked word by word."""
    count, tokens, chance = learned([t for doc, t in rows if not is_held(doc)], model)
    n, v, m = sum(tokens.values()), len(tokens), model.strength
    out = []
    for doc, text in rows:
        row = (*words(text), END)
        state, score = (BEGIN,)[: model.order - 1], 0.0
        for w in row:
            while state and not count[(*state, w)]:
                score += math.log10(m / (count[state] + m))
                state = state[1:]
            score += math.log10(chance((*state, w)))
            state = (*state, w)[1 - model.order :] if model.order > 1 else ()
            while state and not count[state]:
                state = state[1:]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in row)
        out.append((doc, len(row), sum(tokens[w] > 0 for w in row), n, base, score))
    return out


def close(got, expected):
    key = lambda r: (str(r[0]), r[1], round(r[4], 4), round(r[5], 4))
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    np.testing.assert_allclose([r[4:] for r in got], [r[4:] for r in expected], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute(spark, tmp_path, monkeypatch, order):
    """Few words, so that all lengths of n-grams are seen and unseen; many small pieces, buckets and lanes."""
    import random

    draw = random.Random(order)
    rows = [(i, " ".join(draw.choice("aAbcdefgh") for _ in range(draw.randint(0, 40)))) for i in range(150)]
    monkeypatch.setattr(backoff, "piece_words", lambda n: 100)
    monkeypatch.setattr(backoff, "BUCKET", 64)
    docs = table(spark, rows, "doc_id long, text string", tmp_path)
    model = Model(order, 3.0)
    got = backoff.score(docs, ~backoff.held_out("doc_id"), model)
    close(got.collect(), brute(rows, model))


@pytest.mark.parametrize("order", [2, 3])
def test_lanes(spark, tmp_path, monkeypatch, order):
    """A text walked in many lanes has the score it has in one."""
    rows = [(i, " ".join(f"w{(k * k + i) % 23}" for k in range(300))) for i in range(30)]
    docs = table(spark, rows, "doc_id long, text string", tmp_path)
    texts = backoff.read_piece(np.arange(1, 24, dtype=np.uint64).tobytes(), (np.arange(2300) ** 2 % 23).astype(np.uint16).tobytes(), [2000, 300], [True, True], order)
    automaton = backoff.Automaton(texts, texts.counts(), 2302, 24, Model(order))
    monkeypatch.setattr(backoff, "LANE", 10_000)
    expected = automaton.walk()
    for lane in (1, 2, 7, 512):
        monkeypatch.setattr(backoff, "LANE", lane)
        np.testing.assert_allclose(automaton.walk(), expected)
    close(backoff.score(docs, ~backoff.held_out("doc_id"), Model(order)).collect(), brute(rows, Model(order)))


def test_sums_to_one():
    """After every run of words the chances of the known words, the end and one unknown word sum to one."""
    _, tokens, chance = learned(["a b a c a b b", "b c a", "a a a"], Model(3, 5.0))
    for after in ("a", "a b", "b c", "c c", "x a"):
        assert abs(sum(chance((*after.split(), w)) for w in [*tokens, "unseen"]) - 1) < 1e-12


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = backoff.score(docs, ~backoff.held_out("doc_id")).where(backoff.held_out("doc_id"))
    r = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b and r.n > 10_000


def test_odd_rows(spark, tmp_path):
    docs = table(spark, ODD, SCHEMA, tmp_path / "a").withColumn("piece", F.lit("clash")).withColumn("trains", F.lit(1))
    got = backoff.score(docs, ~backoff.held_out("doc_id"), Model(3))
    close(got.collect(), brute([r[:2] for r in ODD], Model(3)))
    assert backoff.score(table(spark, [], SCHEMA, tmp_path / "b"), ~backoff.held_out("doc_id")).collect() == []
    # nothing to train on: all is unknown, and certain
    got = backoff.score(docs, F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
