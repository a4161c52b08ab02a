"""Find and collapse periodic runs of words: stretches such as "a b c a b c a b c a b c".

The words of a text become numbers, and Re-Pair turns them into a grammar: in each round every pair of neighbours that is more
frequent than the pairs it overlaps becomes a nonterminal, until no pair is left that occurs twice. What remains is joined by
a balanced tree, so that the whole text is one derivation. A run lies inside the expansion of a nonterminal and crosses the
boundary between its two parts, or it lies inside one of the parts. So the runs that cross a boundary are computed once for each
nonterminal, and the nonterminal's places in the derivation say where they are in the text. A run that ends where its
expansion ends may be part of a longer one; of intervals with the same period only those in no other one remain.

Words that no run can hold are cut out before: in a run every few words in a row come again one period further on or back.
Texts are independent of each other, so Spark deals them out and a task works on one text at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm.common import WORD
from tidetrace.llm.shingles import mix

_WORD = re.compile(WORD)
#: Further words by which periods are tried before their stretch is measured.
_TRIED = 8
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


@dataclass(frozen=True)
class Rule:
    """A run has at least ``words`` words (3 or more), and at least ``times`` times its period (3 or more)."""

    words: int = 6
    times: int = 4

    def __post_init__(self):
        if self.words < 3 or self.times < 3:
            raise ValueError("runs have three words and three periods at least")

    def least(self, period: int) -> int:
        return max(self.words, self.times * period)

    @cached_property
    def window(self) -> int:
        """So many words in a row, wherever they are in a run, come again in it one period further on or back."""
        fits = lambda size: all(self.least(q) - size + 1 >= 2 * q for q in range(1, self.words + 4))
        return max(size for size in (1, 2, 3, 4) if fits(size))


def stretches(words: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """The stretches (start, end) outside of which no run is, from a hash of each word. Unequal words with one hash only keep more."""
    n, size = len(words), rule.window
    if n < rule.words:
        return []
    key = words[: n - size + 1].astype(np.uint64)
    for k in range(1, size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k].astype(np.uint64)
    ranked = np.sort(key)
    if (ranked[1:] != ranked[:-1]).all():
        return []
    order = np.argsort(key, kind="stable")
    gaps = np.diff(order)
    gaps[key[order[1:]] != key[order[:-1]]] = n
    nearest = np.full(len(key), n)
    nearest[order[1:]] = gaps
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gaps)
    limit = np.full(len(key), n // rule.times)
    while True:
        marked = np.concatenate([[False], nearest <= limit, [False]])
        starts, ends = np.flatnonzero(~marked[:-1] & marked[1:]), np.flatnonzero(marked[:-1] & ~marked[1:])
        long = ends - starts + size - 1
        starts, ends, long = starts[long >= rule.words], ends[long >= rule.words], long[long >= rule.words]
        # a run's period is at most this share of the stretch that holds it
        shorter = np.zeros(len(key), np.int64)
        for a, b, width in zip(starts.tolist(), ends.tolist(), (long // rule.times).tolist()):
            shorter[a:b] = width
        if (shorter == limit).all():
            return [(a, b + size - 1) for a, b in zip(starts.tolist(), ends.tolist())]
        limit = shorter


@dataclass
class Grammar:
    """Nonterminal k has the symbols ``left[k]`` and ``right[k]``, which are below k, and one of its places in ``where``. Symbols
    below ``first`` are words. ``root`` derives the text."""

    first: int
    root: int = 0
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    where: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def add(self, pairs: list[tuple[int, int]], where: list[int]) -> range:
        for (a, b), place in zip(pairs, where):
            self.left.append(a)
            self.right.append(b)
            self.where.append(place)
            self.sizes.append(self.size(a) + self.size(b))
        return range(self.first + len(self.left) - len(pairs), self.first + len(self.left))

    def size(self, symbol: int) -> int:
        return 1 if symbol < self.first else self.sizes[symbol - self.first]


def _replaced(counts: np.ndarray, pair: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The places of the pairs to replace: those more frequent than both pairs they overlap, from the left where equal."""
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((tie, -counts))] = np.arange(len(counts))
    r = rank[pair]
    place = np.arange(len(r))
    fresh = np.concatenate([[True], r[1:] != r[:-1]])
    offset = place - np.maximum.accumulate(np.where(fresh, place, 0))
    last = np.iinfo(np.int64).max
    take = (counts[pair] > 1) & (offset % 2 == 0)
    take &= (r <= np.concatenate([[last], r[:-1]])) & (r <= np.concatenate([r[1:], [last]]))
    return np.flatnonzero(take)


def re_pair(words: np.ndarray) -> Grammar:
    """The grammar of one text of numbers from 0 on."""
    grammar = Grammar(first=int(words.max()) + 1)
    symbols, at = words.astype(np.int64), np.arange(len(words))
    known: dict[int, int] = {}
    while len(symbols) > 1:
        key = (symbols[:-1] << 32) | symbols[1:]
        pairs, pair, counts = np.unique(key, return_inverse=True, return_counts=True)
        if counts.max() < 2:
            break
        places = _replaced(counts, pair, mix(pairs.astype(np.uint64)))
        used, first, of = np.unique(pair[places], return_index=True, return_inverse=True)
        names = []
        for k, place in zip(pairs[used].tolist(), at[places[first]].tolist()):
            if k not in known:
                known[k] = grammar.add([(k >> 32, k & 0xFFFFFFFF)], [place])[0]
            names.append(known[k])
        symbols[places] = np.array(names, np.int64)[of]
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        symbols, at = symbols[stay], at[stay]
    rest, at = symbols.tolist(), at.tolist()
    while len(rest) > 1:
        joined = list(grammar.add(list(zip(rest[::2], rest[1::2])), at[: len(rest) // 2 * 2 : 2]))
        rest, at = joined + rest[len(joined) * 2 :], at[::2]
    grammar.root = rest[0]
    return grammar


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements from the first on are equal."""
    k, size = 0, 32
    while k < len(a):
        differs = a[k : k + size] != b[k : k + size]
        m = int(differs.argmax())
        if differs[m]:
            return k + m
        k, size = k + size, size * 4
    return len(a)


def _tried(words: np.ndarray, lo: int, b: int, hi: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Periods q and places x, ascending by q: the words x - 1 and x equal those q further on. A run that crosses b has more than
    half of its words on one side, so its period shows in the words next to b, compared with that side."""
    most = (hi - lo) // rule.times
    found = []
    right, left = min(most, hi - 1 - b), min(most, b - 1 - lo)
    q = np.flatnonzero((words[b + 1 : b + 1 + right] == words[b]) & (words[b : b + right] == words[b - 1])) + 1
    found.append((q, np.full(len(q), b)))
    q = np.flatnonzero((words[b - 1 - left : b - 1] == words[b - 1]) & (words[b - left : b] == words[b]))
    q = left - q[::-1]
    found.append((q, b - q))
    q, x = (np.concatenate(part) for part in zip(*found))
    for d in range(1, _TRIED):
        if len(q) < 5:
            break
        # a period above 2 d holds d words further to its side too
        y = np.where(x == b, x + d, x - 1 - d)
        inside = (y >= lo) & (y + q < hi)
        y = np.where(inside, y, lo)
        ok = (q <= 2 * d) | (inside & (words[y] == words[np.minimum(y + q, hi - 1)]))
        q, x = q[ok], x[ok]
    order = np.argsort(q, kind="stable")
    return q[order], x[order]


def crossing(words: np.ndarray, lo: int, b: int, hi: int, rule: Rule) -> list[Run]:
    """The runs (start, end, period) of ``words[lo:hi]`` that hold the words on both sides of place ``b``."""
    q, x = _tried(words, lo, b, hi, rule)
    found: dict[tuple[int, int], int] = {}
    while len(q):
        period, place = int(q[0]), int(x[0])
        q, x = q[1:], x[1:]
        end = place + _agree(words[place : hi - period], words[place + period : hi]) + period
        start = place - _agree(words[lo:place][::-1], words[lo + period : place + period][::-1])
        if end - start < rule.least(period) or (start, end) in found:
            continue
        found[start, end] = period
        if (start, end) == (lo, hi):
            break
        if len(q) > 4:
            # another period's run goes on beyond this one, where a word equals the one a period before or after
            on = np.zeros(len(q), bool)
            for y in ([end] if end < hi else []) + ([start - 1] if start > lo else []):
                on |= (y - q >= lo) & (words[np.maximum(y - q, lo)] == words[y])
                on |= (y + q < hi) & (words[np.minimum(y + q, hi - 1)] == words[y])
            q, x = q[on], x[on]
    return [(s, e, period) for (s, e), period in found.items()]


def _translated(words: np.ndarray, ends: list[int], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, ends, period) of every nonterminal's crossing runs at all of its places in the text. At each of ``ends`` is a word
    that is there only, so that no run holds it; the last word is one."""
    grammar = re_pair(words)
    first, many = grammar.first, len(grammar.left)
    runs: list[list[Run]] = []
    holds = [False] * many
    for k in range(many):
        at, size, own = grammar.where[k], grammar.sizes[k], []
        if size >= rule.words:
            b = at + grammar.size(grammar.left[k])
            part = bisect_right(ends, b - 1)
            lo, hi = max(at, ends[part - 1] + 1 if part else 0), min(at + size, ends[part])
            if lo < b < hi and hi - lo >= rule.words:
                own = [(s - at, e - at, q) for s, e, q in crossing(words, lo, b, hi, rule)]
        runs.append(own)
        holds[k] = bool(own) or any(c >= first and holds[c - first] for c in (grammar.left[k], grammar.right[k]))
    places: list[list[np.ndarray]] = [[] for _ in range(many)]
    if grammar.root >= first:
        places[grammar.root - first].append(np.zeros(1, np.int64))
    for k in range(many - 1, -1, -1):
        if not holds[k] or not places[k]:
            continue
        at = np.concatenate(places[k])
        places[k] = []
        for s, e, q in runs[k]:
            yield at + s, at + e, q
        for child, shift in ((grammar.left[k], 0), (grammar.right[k], grammar.size(grammar.left[k]))):
            if child >= first and holds[child - first]:
                places[child - first].append(at + shift)


def runs_of(words: list[str], rule: Rule = Rule()) -> list[Run]:
    """The runs (start, length, period) of a text's words, by start and period: maximal stretches whose smallest period is
    ``period`` and that are as long as ``rule`` asks for. No words have no runs."""
    parts = stretches(np.fromiter(map(hash, words), np.int64, len(words)), rule)
    if not parts:
        return []
    # one text of all stretches, with a word of its own after each, which no run can hold
    ids: dict[str, int] = {}
    numbers, shifts, ends = [], [], []
    for start, end in parts:
        shifts.append(start - len(numbers))
        numbers += [ids.setdefault(w, len(ids)) for w in words[start:end]]
        ends.append(len(numbers))
        numbers.append(-1)
    joined = np.array(numbers, np.int32)
    joined[joined < 0] = np.arange(len(ids), len(ids) + len(parts))
    by_period: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for s, e, q in _translated(joined, ends, rule):
        by_period.setdefault(q, []).append((s, e))
    out: list[Run] = []
    for q, found in by_period.items():
        s, e = (np.concatenate(side) for side in zip(*found))
        order = np.lexsort((-e, s))
        s, e = s[order], e[order]
        inside = np.concatenate([[False], e[1:] <= np.maximum.accumulate(e)[:-1]])
        s, e = s[~inside], e[~inside]
        at = s + np.array(shifts)[np.searchsorted(ends, s)]
        out += [(a, n, q) for a, n in zip(at.tolist(), (e - s).tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words, one blank between them, without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return " ".join(w for w, d in zip(words, np.cumsum(depth).tolist()) if not d)


def find_runs(documents: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs (start, length, period) by start and period, counted in words
    from 0, and its text without their repetitions. Null, empty and blank texts have no words, no runs and an empty text.
    Repeated rows and null ids are rows like others; other columns are left out, and an empty table gives an empty result.
    """
    rows = documents.select("doc_id", F.col(text).alias("text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    kind = pa.list_(pa.field("element", pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]), False))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, every, left = [], [], []
            for value in batch.column(1).to_pylist():
                words = _WORD.findall(value or "")
                runs = runs_of(words, rule)
                counts.append(len(words))
                every.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left.append(collapsed(words, runs))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(every, kind), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(find, T.StructType([rows.schema["doc_id"], *fields]))


def looped(doc_id: str, text: str) -> Column:
    """The text; where crc32 of the id in decimal ends in 0, words from a on are the p words from there again and again.

    With n words and g the checksum without its last digit, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id or
    text stays as it is, and so does a text without words.
    """
    check = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(check / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(block, 1, n - a)), " ")

    # a lambda's variable, so that the words are cut once
    found = F.array(F.regexp_extract_all(text, F.lit(f"({WORD})")))
    again = F.transform(found, lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(F.col(text)))[0]
    return F.when((check % 10 == 0) & F.col(text).isNotNull(), again).otherwise(F.col(text))


def digest(found: DataFrame) -> DataFrame:
    """``find_runs`` as ``doc_id, n_runs``, the place and measures of the run with the greatest length / period (the first of
    equal ones; nulls without a run), and SHA-256 digests of all runs and of the collapsed text."""
    better = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    best = F.aggregate("runs", F.lit(None).cast(RUNS.elementType), lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best_of = found.withColumn("best", best)
    return best_of.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
