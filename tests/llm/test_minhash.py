from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from text_cases import ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import minhash, shingles

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = [w.translate(UPPER) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """{id: (size of the set, smallest linked id)} by comparing all sets that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    holders = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for g in sets[d] for e in holders[g])
        for e, n in common.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                low[b] = a
        for g in sets[d]:
            holders[g].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def texts():
    """Chains of edits, a large group of near copies, exact copies and unrelated texts."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 5)))
    fresh = lambda n: [word() for _ in range(n)]
    out = [" ".join(fresh(draw.randint(1, 60))) for _ in range(60)]
    base = fresh(80)
    for _ in range(160):
        copy = list(base)
        for _ in range(draw.randint(1, 5)):
            copy[draw.randrange(80)] = word()
        out.append(" ".join(copy))
    chain = fresh(70)
    for _ in range(40):
        out.append("\n".join(chain))
        chain = chain[2:] + fresh(2)
    out += [out[3].upper(), out[4], out[4], "a b", "A\tB", "c"]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [512, 3])
def test_against_all_pairs(spark, tmp_path, monkeypatch, block):
    """Whatever the size of the blocks in which a bucket's members are compared, and however ids are joined."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(minhash, "SENT_IDS", 0 if block == 3 else 1 << 20)
    rows = texts()
    got = minhash.near_duplicates(table(spark, rows, "id long, text string", tmp_path)).collect()
    assert {r.id: (r.n_shingles, r.component) for r in got} == brute(rows)


def test_odd_rows(spark, tmp_path):
    docs = table(spark, ODD, SCHEMA, tmp_path / "a").select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("component"))
    got = sorted(((r.id, r.n_shingles, r.component) for r in minhash.near_duplicates(docs).collect()), key=str)
    size = len(shingle_set(ODD[6][1]))
    expected = [(1, 6, 1), (1, 6, 1), (None, 6, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, size, 5), (6, 1, 6)]
    assert got == sorted(expected, key=str)
    empty = table(spark, [], "id long, text string", tmp_path / "b")
    assert minhash.near_duplicates(empty).collect() == []


def test_words_of_a_batch():
    """Words are the pattern's, wherever a text stands in the batch and however long it is."""
    given = ["a bb\tccc", None, "", " é\x0bÉ  x ", "Bb", "q" * 3_000_000 + " a"]
    found = {}
    for piece in shingles.words(pa.array(given).slice(1)):
        for k in range(len(piece.bounds) - 1):
            span = slice(piece.bounds[k], piece.bounds[k + 1])
            cut = [bytes(piece.data[a:b]).decode() for a, b in zip(piece.starts[span], piece.ends[span])]
            found[piece.first + k] = dict(zip((w.translate(UPPER) for w in cut), piece.hashes[span].tolist()))
            assert cut == WORD.findall(given[piece.first + k + 1] or "")
    assert sorted(found) == list(range(5))
    assert found[2]["é"] != found[2]["É"]
    first = next(shingles.words(pa.array(["a bb A"])))
    assert first.hashes[0] == first.hashes[2] == found[4]["a"] and first.hashes[1] == found[3]["bb"]


def test_long_sets_are_taken_in_pieces(monkeypatch):
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 63, n, np.uint64)) for n in (1, 5000, 17, 300)]
    whole = minhash._minima(sets, minhash.Plan())
    monkeypatch.setattr(minhash, "_PIECE", 64)
    assert (minhash._minima(sets, minhash.Plan()) == whole).all()
