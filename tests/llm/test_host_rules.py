from __future__ import annotations

import random
import re

import pytest
from text_cases import ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import host_rules
from tidetrace.llm.common import WORD


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = list(zip(words, words[1:], words[2:]))
    lines = text.split("\n")
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(bool(re.search(WORD, line)) and line in lines[:i] for i, line in enumerate(lines)),
        len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}),
    )


def test_statistics():
    draw = random.Random(6)
    parts = ["a", "b", "a b a", "##", "\n", " ", "\t\n", "é", " ", "x\x0by", "\n\n", "a b a b"]
    for _ in range(2000):
        text = " ".join(draw.choice(parts) for _ in range(draw.randint(0, 15))) + draw.choice(["", "\n"])
        assert host_rules.text_stats(text) == brute(text), repr(text)
    assert host_rules.text_stats(None) == (0, 0, 0, 0, 0)


def test_verdicts(spark, tmp_path):
    """Few bad documents don't condemn a host, many do; a null host is one too."""
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    rows = [(i, good if i % 7 else bad, f"good{i % 20}") for i in range(400)]
    rows += [(1000 + i, bad, "junk") for i in range(300)] + [(2000, good, "junk"), (3000, bad, "tiny"), (3001, good, "tiny")]
    rows += [(4000, good, None), (4001, None, None), (4002, "", None)]
    docs = table(spark, rows, "doc_id long, text string, source string", tmp_path / "a")
    stats = host_rules.with_stats(docs, ("doc_id", "source"))
    got = {r.doc_id: (r.base_failed, r.kept) for r in host_rules.judge(stats, "source").collect()}
    assert got[2000] == (False, False) and got[1000] == (True, False)
    assert got[1] == (False, True) and got[3001] == (False, True) and got[4000] == (False, True)
    assert got[7] == got[3000] == got[4001] == got[4002] == (True, False)
    rates = {r.host: r.rate_short for r in host_rules.host_verdicts(stats, "source").collect()}
    assert 300 / 301 > rates["junk"] > 0.9 and 0.5 > rates["tiny"] > 0.1


def test_odd_rows(spark, tmp_path):
    docs = table(spark, ODD, SCHEMA, tmp_path / "a").withColumn("_text", F.lit(1)).withColumn("_host", F.lit(2))
    stats = host_rules.with_stats(docs, ("doc_id", "source", "_host"))
    judged = host_rules.judge(stats, "source")
    assert judged.columns == ["doc_id", "source", "_host", *host_rules.STATS, "base_failed", "kept"]
    got = judged.select("doc_id", *host_rules.STATS, "base_failed").collect()
    expected = [(r[0], *(s := host_rules.text_stats(r[1])), s[0] < 50) for r in ODD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, expected)))
    empty = host_rules.with_stats(table(spark, [], SCHEMA, tmp_path / "b"), ("doc_id", "source"))
    assert host_rules.judge(empty, "source").collect() == []
    with pytest.raises(ValueError):
        host_rules.with_stats(docs.withColumn("N_words", F.lit(1)), ("doc_id", "N_words"))
