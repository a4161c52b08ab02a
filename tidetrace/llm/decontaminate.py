"""Find passages of benchmark items in training texts, edited ones too.

Seeds are three words of the items, in a row or with one of four left out. One pass counts in how many documents each seed occurs; an item keeps those
that are rare for it. In a second pass, documents that hold a kept seed have the text around it aligned with the item by
Smith-Waterman over words, and pairs with a high enough score are reported.

Items are taken in blocks of bounded size, each sent to all tasks; the documents are read twice for each block and only
counts and findings leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm import shingles
from tidetrace.llm.common import written


@dataclass(frozen=True)
class Rule:
    """The places of a seed's words are one of ``seeds``. A seed is rare for an item if at most ``rare`` times as many documents hold it as hold the
    item's median seed. Alignments score ``match`` for equal words and -1 for other words and gaps; a pair is reported from
    ``least`` times the score of the whole item on, and whatever its share if ``run`` words in a row are the item's. Items under ``shortest`` words say too little and match nothing."""

    seeds: tuple[tuple[int, ...], ...] = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
    rare: int = 4
    match: int = 2
    least: float = 0.4
    run: int = 13
    shortest: int = 8
    #: Items of one block have about so many words together: 8 MB of seeds.
    block_words: int = 1 << 20


#: Factors of the words of a seed.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _lowered(texts: pa.Array) -> Iterator[shingles.Words]:
    """Words of letters and digits in lower case."""
    return shingles.words(pc.utf8_lower(texts), shingles.BARE)


def _picked(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """The hash of the words at ``places`` from each word on that has them all. Other places give other hashes."""
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, sum(1 << k for k in places), np.uint64)
    for k, place in enumerate(places):
        out += words[place : n + place] * np.uint64(_ODD[k])
    return shingles.mix(out)


class Seeds:
    """The seeds of a block of items: sorted distinct hashes, and where each occurs in an item."""

    def __init__(self, items: list[np.ndarray], rule: Rule):
        runs = [_picked(words, places) for words in items for places in rule.seeds]
        of = np.repeat(np.arange(len(items)), len(rule.seeds))
        every = np.concatenate([*runs, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hashes, first = np.unique(every[order], return_index=True)
        self.bounds = np.append(first, len(every))
        self.item = np.repeat(of, [len(r) for r in runs])[order]
        self.place = np.concatenate([*(np.arange(len(r)) for r in runs), np.zeros(0, np.int64)])[order]
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self.hashes & np.uint64((1 << 22) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes`` that are seeds, and which."""
        at = np.flatnonzero(self.marks[hashes & np.uint64((1 << 22) - 1)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[which] == hashes[at]
        return at[same], which[same]


def _hits(piece: shingles.Words, seeds: Seeds, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, seed) of the seeds in a piece, those across two texts left out."""
    found = []
    for places in rule.seeds:
        at, which = seeds.find(_picked(piece.hashes, places))
        text = np.searchsorted(piece.bounds, at, side="right") - 1
        inside = at + places[-1] < piece.bounds[text + 1]
        at, which, text = at[inside], which[inside], text[inside]
        found.append((text, at - piece.bounds[text], which))
    return tuple(np.concatenate(c) for c in zip(*found))


def align(item: np.ndarray, words: np.ndarray, match: int = 2) -> tuple[int, int]:
    """(score, end) of the best local alignment of an item with words; ``end`` is the place after its last word.

    A row of the table at a time: the best value that a gap along the row can carry on is a running maximum.
    """
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == word, match, -1))
        row = np.maximum.accumulate(new + steps) - steps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def longest_run(item: np.ndarray, words: np.ndarray) -> int:
    """The most words in a row that an item and words share."""
    row = np.zeros(len(words) + 1, np.int64)
    best = 0
    for word in item:
        row[1:] = np.where(words == word, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def _passages(words: np.ndarray, hits: np.ndarray, item: np.ndarray, match: int) -> tuple[int, int, int, int]:
    """(score, first word, place after the last) of an item's best passage, given where it would begin for each seed hit, and
    the longest run of the item's words in any."""
    best, run = (0, 0, 0), 0
    hits = np.unique(hits)
    size = len(item)
    for group in np.split(hits, np.flatnonzero(np.diff(hits) > size) + 1):
        low = max(0, int(group[0]) - size // 2)
        window = words[low : int(group[-1]) + size + size // 2]
        score, end = align(item, window, match)
        if score > best[0]:
            _, back = align(item[::-1], window[:end][::-1], match)
            best = (score, low + end - back, low + end)
        run = max(run, longest_run(item, window))
    return *best, run


def _read_items(benchmark: DataFrame, blocks: int, block: int, rule: Rule) -> tuple[list, list[np.ndarray]]:
    """Ids and words of the items of one block."""
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    rows = benchmark.where(F.col("text").isNotNull() & (place == block)).select("item_id", "text").distinct().collect()
    ids, items = [], []
    for piece in _lowered(pa.array([r["text"] for r in rows], pa.string())):
        for k, (a, b) in enumerate(zip(piece.bounds[:-1], piece.bounds[1:])):
            if b - a >= rule.shortest:
                ids.append(rows[piece.first + k]["item_id"])
                items.append(piece.hashes[a:b])
    return ids, items


def _rare(documents: DataFrame, seeds: Seeds, rule: Rule) -> np.ndarray:
    """Whether each place of an item is a rare seed of it."""
    sent = documents.sparkSession.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        held = np.zeros(len(known.hashes), np.int64)
        for batch in batches:
            for piece in _lowered(batch.column(0)):
                text, _, which = _hits(piece, known, rule)
                pairs = np.unique(text * len(known.hashes) + which) % max(len(known.hashes), 1)
                held += np.bincount(pairs, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["seed", "n"])

    counted = documents.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    held = np.zeros(len(seeds.hashes), np.int64)
    for row in counted.toLocalIterator():
        held[row["seed"]] = row["n"]
    each = np.repeat(held, np.diff(seeds.bounds))
    rare = np.zeros(len(each), bool)
    order = np.argsort(seeds.item, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(seeds.item[order])) + 1):
        if len(places):
            rare[places] = each[places] <= rule.rare * max(1.0, float(np.median(each[places])))
    return rare


def _scan(documents: DataFrame, ids: list, items: list[np.ndarray], id_type: T.DataType, rule: Rule) -> DataFrame:
    seeds = Seeds(items, rule)
    rare = _rare(documents, seeds, rule)
    sent = documents.sparkSession.sparkContext.broadcast((ids, items, seeds, rare))
    rows = documents.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("item_id", id_type),
            T.StructField("score", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, known, kept = sent.value
        for batch in batches:
            of, found = [], []
            for piece in _lowered(batch.column(1)):
                text, place, which = _hits(piece, known, rule)
                # a row for each place of an item at which a found seed is rare
                times = known.bounds[which + 1] - known.bounds[which]
                at = np.repeat(known.bounds[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                begin = np.repeat(place, times) - known.place[at]
                pair = np.repeat(text, times) * len(wanted) + known.item[at]
                pair, begin = pair[kept[at]], begin[kept[at]]
                order = np.argsort(pair, kind="stable")
                pair, begin = pair[order], begin[order]
                cuts = np.flatnonzero(np.diff(pair)) + 1
                for group, starts in zip(np.split(pair, cuts), np.split(begin, cuts)):
                    if not len(group):
                        continue
                    k, i = divmod(int(group[0]), len(wanted))
                    words = piece.hashes[piece.bounds[k] : piece.bounds[k + 1]]
                    score, first, last, run = _passages(words, starts, wanted[i], rule.match)
                    score /= rule.match * len(wanted[i])
                    if score >= rule.least or run >= rule.run:
                        of.append(piece.first + k)
                        found.append((names[i], score, first, last - 1))
            columns = [pa.array([f[k] for f in found]) for k in range(4)]
            columns = [c.cast(t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    return rows.mapInArrow(scan, schema)


def find_passages(documents: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word``: the best passage of each document for each item that it holds.

    ``documents`` is a table (doc_id, text), ``benchmark`` (item_id, text). ``score`` is the alignment's share of the whole
    item's, the words are places among the document's runs of letters and digits. Null and empty texts hold nothing and are
    held by nothing; a repeated document has its rows again, a repeated item counts once. Without items the result is empty.
    """
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // (6 * rule.block_words) + 1
    parts = []
    for block in range(blocks):
        ids, items = _read_items(benchmark, blocks, block, rule)
        found = _scan(documents, ids, items, benchmark.schema["item_id"].dataType, rule)
        parts.append(written(found, "passages") if blocks > 1 else found)
    return reduce(DataFrame.union, parts)
