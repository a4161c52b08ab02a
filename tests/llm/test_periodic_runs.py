from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_cases import ODD, SCHEMA, table

from tidetrace.llm import periodic_runs
from tidetrace.llm.periodic_runs import Rule, runs_of


def brute(words, least=6, times=4):
    """Maximal stretches of every period, those of a smaller period left out."""
    out, seen = [], set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    draw = random.Random(4)
    for _ in range(400):  # few different words, all kinds of runs by chance
        yield [draw.choice("ab") for _ in range(draw.randint(0, 60))]
    for _ in range(300):
        out = []
        while len(out) < draw.randint(1, 200):
            block = [draw.choice("abcdefgh"[: draw.randint(1, 8)]) for _ in range(draw.randint(1, 12))]
            out += block * draw.randint(1, 9)
            out = out[: len(out) - draw.randint(0, len(block))] or ["x"]
        yield out
    for inner in (5, 7):  # runs of runs
        block = ["a", "b"] * inner + ["c"]
        yield (block * 5 + ["d"]) * 6
    fib = ["a"], ["a", "b"]
    for _ in range(10):
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    yield ["w"] * 3000
    yield ["w"] * 1000 + ["v"] + ["w"] * 700 + ["v", "u"] + ["w"] * 5


def test_against_brute():
    n = 0
    for words in texts():
        got = runs_of(words)
        assert got == brute(words), words[:80]
        assert periodic_runs.collapsed(words, got) == left(words, got)
        n += len(got)
    assert n > 500


@pytest.mark.parametrize("rule", [Rule(3, 3), Rule(10, 5), Rule(4, 3)])
def test_other_rules(rule):
    for words in list(texts())[::5]:
        assert runs_of(words, rule) == brute(words, rule.words, rule.times)


def test_cut_loses_nothing(monkeypatch):
    """The same runs from the grammar of the whole text."""
    some = [w for w in texts() if w][::3]
    expected = [runs_of(w) for w in some]
    monkeypatch.setattr(periodic_runs, "stretches", lambda words, rule: [(0, len(words))])
    assert [runs_of(w) for w in some] == expected


def test_grammar():
    """Every nonterminal derives the words at its place, and the root all."""
    for words in [w for w in texts() if w][::7]:
        numbers = np.unique(np.array(words), return_inverse=True)[1]
        g = periodic_runs.re_pair(numbers)
        expand = {k: [k] for k in range(g.first)}
        for k, (a, b) in enumerate(zip(g.left, g.right), g.first):
            expand[k] = expand[a] + expand[b]
            at = g.where[k - g.first]
            assert expand[k] == numbers[at : at + len(expand[k])].tolist()
        assert expand[g.root] == numbers.tolist()
    # 3,000 equal words take a few nonterminals, not thousands
    assert len(periodic_runs.re_pair(np.zeros(3000, np.int64)).left) < 40


def test_long_runs_in_linear_time():
    """Half a million words in one run, and in many."""
    import time

    began = time.process_time()
    assert runs_of(["w"] * 500_000) == [(0, 500_000, 1)]
    block = [f"w{i}" for i in range(5000)]
    assert runs_of(block * 100) == [(0, 500_000, 5000)]
    assert len(runs_of((["a"] * 6 + ["b"]) * 3 + [f"{k}{i}" for i in range(30_000) for k in "xxxxxxy"])) >= 3
    assert time.process_time() - began < 60


def rewritten(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if words and h is not None and h % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc, text):
    words = rewritten(doc, text)
    runs = brute(words)
    best = (None,) * 4
    if runs:
        s, n, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = (s, n, q, 1000 * n // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left(words, runs)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def check(docs, rows):
    found = periodic_runs.find_runs(docs.withColumn("text", periodic_runs.looped("doc_id", "text")))
    got = [tuple(r[c] for c in COLUMNS) for r in periodic_runs.digest(found).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*r[:2])) for r in rows)


def test_table(spark):
    """The given small table, loops and all."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(docs, rows)
    assert sum(expected(*r)[1] > 0 for r in rows) > 5


def test_odd_rows(spark, tmp_path):
    rows = [r for r in ODD if r[0] != 5] + [(i, " ".join("x y".split() * 9), "en", "a", 1) for i in range(20, 60)]
    docs = table(spark, rows, SCHEMA, tmp_path / "a").withColumn("runs", F.lit("clash")).withColumn("words", F.lit(1))
    check(docs, rows)
    empty = periodic_runs.digest(periodic_runs.find_runs(table(spark, [], SCHEMA, tmp_path / "b")))
    assert empty.collect() == [] and empty.columns == list(COLUMNS)
