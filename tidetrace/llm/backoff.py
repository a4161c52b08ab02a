"""Score texts with a weighted backoff automaton of n-grams learned from the collection.

States are the runs of up to ``order - 1`` words seen in training, the empty run among them. From a state an arc for each word
seen after it leads to the longest state that ends there, with the log-probability of the word; a failure arc leads to the state
without its first word, with the log of the mass that is left for words not seen after it. A text is walked once from left
to right: the state goes along, a word without an arc takes failure arcs until there is one, and all weights add up.

The probability of a word w after a run h is smoothed by that after the run h' without its first word,

    p(w | h) = (c(hw) + strength * p(w | h')) / (c(h) + strength),    p(w) = (c(w) + 1) / (N + V + 1),

so that they sum to one over the V known words and the unknown one, and a failure arc weighs strength / (c(h) + strength).

Nothing that grows with the collection is held in one place. Texts are cut into pieces of a bounded number of words. A piece
sends the distinct n-grams of its words, with their counts in training, to buckets of n-grams; a bucket adds up the counts and
sends each piece the totals of what it asked for; and the piece's part of the automaton is built next to its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm import shingles
from tidetrace.llm.common import written

#: What ends and what precedes every text: tokens that no word can be.
_END, _BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_ODD = np.uint64(1)
#: n-grams in a bucket, on average.
BUCKET = 1 << 20
#: Tokens that are walked one after the other; longer texts go on in other lanes from the state they had there.
LANE = 512


@dataclass(frozen=True)
class Model:
    """``order`` words are the longest n-gram; the larger ``strength``, the more a run's counts are smoothed."""

    order: int = 2
    strength: float = 200.0


def piece_words(total: int) -> int:
    """Words in a piece: more in larger collections, so that a frequent n-gram is asked for by a bounded number of pieces."""
    return min(max(total >> 12, 1 << 18), 1 << 23)


def _width(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def cut(documents: DataFrame, trains: Column, words: int) -> DataFrame:
    """The texts in pieces, a row each: ``piece``; ``ids``, ``trains`` and ``sizes`` (words) of its texts; ``vocabulary``, 64-bit
    hashes of its words; ``tokens``, for each word its place there. ``documents`` is (doc_id, text)."""
    rows = documents.select("doc_id", "text", trains.alias("trains"))
    fields = [
        T.StructField("piece", T.LongType()),
        T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType)),
        T.StructField("trains", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("vocabulary", T.BinaryType()),
        T.StructField("tokens", T.BinaryType()),
    ]
    names = [f.name for f in fields]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pyspark.TaskContext.get().partitionId() << 32
        held, size = [], 0

        def piece() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate([h for _, _, h, _ in held]), return_inverse=True)
            ids = pa.concat_arrays([i for i, _, _, _ in held])
            trains = pa.concat_arrays([t for _, t, _, _ in held])
            sizes = pa.array(np.concatenate([n for _, _, _, n in held]), pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, trains, sizes)]
            blobs = [pa.array([a.tobytes()], pa.binary()) for a in (vocabulary, tokens.astype(_width(len(vocabulary))))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, *blobs], names)

        for batch in batches:
            for part in shingles.words(batch.column(1)):
                sizes = np.diff(part.bounds)
                place = slice(part.first, part.first + len(sizes))
                held.append((batch.column(0)[place], batch.column(2)[place], part.hashes, sizes))
                size += len(part.hashes)
                if size >= words:
                    yield piece()
                    number, held, size = number + 1, [], 0
        if held:
            yield piece()

    return rows.mapInArrow(gather, T.StructType(fields))


@dataclass
class Texts:
    """A piece's tokens in a row: for each text the one before it, its words, and the end. ``grams[k]`` has for each token the
    number of the n-gram of k + 1 tokens that ends there, -1 where the text has too few; numbers follow the order of ``keys``."""

    starts: np.ndarray
    sizes: np.ndarray
    trains: np.ndarray
    keys: np.ndarray
    grams: list[np.ndarray]

    def counts(self) -> np.ndarray:
        """How often each n-gram is in the texts to train on."""
        learned = np.repeat(self.trains, self.sizes)
        total = np.zeros(len(self.keys), np.int64)
        for gram in self.grams:
            total += np.bincount(gram[learned & (gram >= 0)], minlength=len(self.keys))
        return total


def read_piece(vocabulary: bytes, tokens: bytes, sizes: list[int], trains: list[bool], order: int) -> Texts:
    known = np.frombuffer(vocabulary, np.uint64)
    hashes = known[np.frombuffer(tokens, _width(len(known)))]
    sizes = np.asarray(sizes, np.int64)
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    row = np.empty(len(hashes) + 2 * len(sizes), np.uint64)
    inner = np.ones(len(row), bool)
    inner[starts] = inner[ends - 1] = False
    row[starts], row[ends - 1], row[inner] = _BEGIN, _END, hashes
    before = np.arange(len(row)) - np.repeat(starts, sizes + 2)
    keys, places = [], []
    for k in range(order):
        # the lowest bit tells single tokens from longer n-grams
        key = row | _ODD if not k else shingles.runs(row, k + 1) & ~_ODD
        place = np.flatnonzero(before >= k)
        keys.append(key[place - k])
        places.append(place)
    unique, of = np.unique(np.concatenate(keys), return_inverse=True)
    grams, at = [], 0
    for place in places:
        gram = np.full(len(row), -1)
        gram[place] = of[at : at + len(place)]
        grams.append(gram)
        at += len(place)
    return Texts(starts, sizes + 2, np.asarray(trains, bool), unique, grams)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys are cut into the buckets, which are ranges of keys."""
    limits = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def _packed(numbers: np.ndarray) -> bytes:
    """Eight byte strings in a row, one for each byte of the numbers: most of them are zeros, which shuffles compress."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pieces(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[dict, Texts]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            yield row, read_piece(row["vocabulary"], row["tokens"], row["sizes"], row["trains"], order)


def totals(pieces: DataFrame, model: Model, buckets: int) -> DataFrame:
    """``bucket, piece, totals`` of the n-grams of every piece in training, in the order of their keys. ``known`` and ``tokens`` of a
    bucket's first row count its distinct training tokens and all of them."""
    sent = "bucket int, piece long, keys binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in _pieces(batches, model.order):
            counts, edges = texts.counts(), _edges(texts.keys, buckets)
            full = np.flatnonzero(np.diff(edges)).tolist()
            blobs = [[], []]
            for b in full:
                part = slice(edges[b], edges[b + 1])
                blobs[0].append(_packed(np.diff(texts.keys[part], prepend=np.uint64(0))))
                blobs[1].append(_packed(counts[part]))
            columns = [pa.array(full, pa.int32()), pa.array([row["piece"]] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "piece", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        counts = [_unpacked(c).astype(np.int64) for c in table.column("counts").to_pylist()]
        unique, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(counts), len(unique)).astype(np.int64)
        token = (unique & _ODD == _ODD) & (unique != (_BEGIN | _ODD))
        blobs, at = [], 0
        for k in keys:
            blobs.append(_packed(total[of[at : at + len(k)]]))
            at += len(k)
        rest = [0] * (len(keys) - 1)
        return pa.table({
            "bucket": table.column("bucket"),
            "piece": table.column("piece"),
            "totals": pa.array(blobs, pa.binary()),
            "known": pa.array([int((total[token] > 0).sum()), *rest], pa.int64()),
            "tokens": pa.array([int(total[token].sum()), *rest], pa.int64()),
        })

    asked = pieces.mapInArrow(send, sent)
    return asked.groupBy("bucket").applyInArrow(add, "bucket int, piece long, totals binary, known long, tokens long")


class Automaton:
    """The part of the automaton that a piece's texts can reach. States and arcs are n-grams, by their numbers in ``texts``:
    ``fail[g]`` weighs the failure arc of the state g, ``arc[g]`` the arc that completes g, and an n-gram without it has a NaN."""

    def __init__(self, texts: Texts, count: np.ndarray, tokens: int, known: int, model: Model):
        self.texts, self.order = texts, model.order
        self.fail = np.log10(model.strength / (count + model.strength))
        chance = np.zeros(len(count))
        first = texts.grams[0]
        chance[first] = (count[first] + 1) / (tokens + known + 1)
        for k in range(1, model.order):
            place = np.flatnonzero(texts.grams[k] >= 0)
            gram, of = np.unique(texts.grams[k][place], return_index=True)
            place = place[of]
            run, shorter = texts.grams[k - 1][place - 1], texts.grams[k - 1][place]
            smoothed = (count[gram] + model.strength * chance[shorter]) / (count[run] + model.strength)
            chance[gram] = np.where(count[gram] > 0, smoothed, np.nan)
        with np.errstate(divide="ignore"):
            self.arc = np.log10(chance)

    def walk(self) -> np.ndarray:
        """The log-probability of each text. Texts are walked side by side, long ones in several lanes: a lane that begins inside a
        text first walks the ``order - 1`` tokens before, which is all that a state depends on, without adding them up."""
        texts, order = self.texts, self.order
        lanes = -(-(texts.sizes - 1) // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = texts.starts[text] + 1 + step * LANE
        end = np.minimum(begin + LANE, texts.starts[text] + texts.sizes[text])
        at = np.maximum(begin - (order - 1), texts.starts[text] + 1)
        # the state is the run of so many tokens before ``at``
        state = np.full(len(text), min(order - 1, 1))
        state[at > texts.starts[text] + 1] = 0
        total = np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            here = at[live]
            size, weight = state[live] + 1, np.zeros(len(live))
            for k in range(order - 1, 0, -1):
                gram = texts.grams[k][here]
                stuck = (size == k + 1) & np.isnan(self.arc[gram])
                weight[stuck] += self.fail[texts.grams[k - 1][here[stuck] - 1]]
                size[stuck] = k
            for k in range(order):
                on = size == k + 1
                weight[on] += self.arc[texts.grams[k][here[on]]]
            state[live] = np.minimum(size, order - 1)
            total[live] += np.where(here >= begin[live], weight, 0)
            at[live] += 1
            live = live[at[live] < end[live]]
        return np.bincount(text, total, len(lanes))


def score(documents: DataFrame, trains: Column, model: Model = Model()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, learned from the rows where ``trains`` holds.

    Words are lower-cased (A-Z), and an end follows the last one. ``n_known`` counts tokens seen in training, ``base_score`` is the
    log-probability (base 10) of the tokens by their own counts, ``score`` that of the text by the automaton. A null or empty
    text is its end alone. A null in ``trains`` is taken as false; repeated rows count each. An empty table gives an empty
    result; without rows to train on all tokens are unknown. n-grams are counted by 64-bit hashes.
    """
    rows = documents.select("doc_id", "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    # at most this many words: every other character is a blank
    most = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0] // 2
    pieces = written(cut(rows, F.col("trains"), piece_words(most)), "pieces")
    buckets = max(1, most * model.order // (2 * BUCKET))
    counted = written(totals(pieces, model, buckets), "totals")
    known, tokens = counted.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    kind = rows.schema["doc_id"]
    out = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = T.StructType([kind, *T._parse_datatype_string(out).fields])

    def walked(piece: pa.Table, parts: pa.Table) -> pa.Table:
        (row, texts), = _pieces(piece.to_batches(), model.order)
        order = np.argsort(parts.column("bucket").to_numpy())
        blobs = parts.column("totals").to_pylist()
        count = np.concatenate([_unpacked(blobs[k]) for k in order.tolist()]).astype(np.int64)
        automaton = Automaton(texts, count, tokens, known, model)
        token = np.ones(len(texts.grams[0]), bool)
        token[texts.starts] = False
        of = np.repeat(np.arange(len(texts.sizes)), texts.sizes)[token]
        single = texts.grams[0][token]
        add = lambda weights: np.bincount(of, weights, len(texts.sizes))
        n = len(texts.sizes)
        columns = [
            piece.column("ids").combine_chunks().flatten(),
            pa.array(texts.sizes - 1, pa.int64()),
            pa.array(add(count[single] > 0).astype(np.int64)),
            pa.array(np.full(n, tokens), pa.int64()),
            pa.array(add(automaton.arc[single])),
            pa.array(automaton.walk()),
        ]
        return pa.table(columns, schema.names)

    return pieces.groupBy("piece").cogroup(counted.groupBy("piece")).applyInArrow(walked, schema)


def held_out(doc_id: str | Column) -> Column:
    """Rows that training leaves out: crc32 of the id as text leaves 2 when divided by 7. A null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))
