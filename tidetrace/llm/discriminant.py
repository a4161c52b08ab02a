"""Quality scores from a regularised quadratic discriminant.

Statistics of a text, transformed to be near normal, are modelled by one normal distribution per class. Each class
covariance is shrunk towards the diagonal of the pooled one. The score of a text is the probability of class 1 from the
difference of the two log densities: half the difference of the Mahalanobis distances and of the log determinants, both
from the Cholesky factors, which are computed once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm.common import WORD

FEATURES = (
    "log_words", "word_length", "word_spread", "upper", "symbols", "marks", "digits", "blanks",
    "distinct_words", "distinct_pairs", "top_word", "line_words", "dup_lines", "bare_words",
)
_WORD = re.compile(WORD)
_UPPER, _SYMBOL, _MARK, _DIGIT, _BLANK = 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    """The class of each code point below 0x250; 0 is everything else."""
    kinds = np.zeros(0x250, np.uint8)
    for code in range(0x250):
        char = chr(code)
        if char.isupper():
            kinds[code] = _UPPER
        elif char in "#*$%&|<>{}[]\\^~=_@+/":
            kinds[code] = _SYMBOL
        elif char in "!?.,;:'\"()-":
            kinds[code] = _MARK
        elif char.isdigit():
            kinds[code] = _DIGIT
        elif char.isspace():
            kinds[code] = _BLANK
    return kinds


_CLASSES = _classes()


def _share(part: float, whole: float) -> float:
    """Log odds of a share, held in by half a count."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def features(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``FEATURES``; null is taken as empty."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), len(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_CLASSES[np.minimum(codes, 0x24F)], minlength=6)
    lengths = np.fromiter(map(len, words), np.float64, n)
    mean = lengths.mean() if n else 0.0
    distinct = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    top = max(distinct.values()) / n if n else 0.0
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    bare = sum(not w[0].isalnum() and not any(map(str.isalnum, w)) for w in distinct)
    return [
        float(np.log1p(n)),
        float(np.log1p(mean)),
        float(np.log1p(lengths.std() if n else 0.0)),
        _share(kinds[_UPPER], chars),
        _share(kinds[_SYMBOL], chars),
        _share(kinds[_MARK], chars),
        _share(kinds[_DIGIT], chars),
        _share(kinds[_BLANK], chars),
        _share(len(distinct), max(n, 1)) + float(0.5 * np.log1p(n)),
        _share(n - 1 - pairs if n > 1 else 0, max(n - 1, 0)),
        float(np.log(top + 0.01)),
        float(np.log1p(n / max(len(lines), 1))),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(bare, len(distinct)),
    ]


def with_features(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the array of statistics, for every row."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    return rows.mapInArrow(measure, T.StructType([rows.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Discriminant:
    """Class means and inverse Cholesky factors; ``shift`` holds log determinants and prior. Without them, ``prior`` alone."""

    prior: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    shift: float = 0.0
    scale: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        far = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip(self.scale * (0.5 * (far[0] - far[1]) + self.shift), -700, 700)))


def fit(rows: DataFrame, label: str = "label", shrink: float = 0.05, scale: float = 0.25) -> Discriminant:
    """Fit on (label 0 or 1, x). Only sums of the statistics and of their products come to the driver, a row per class.

    A class covariance S becomes (1 - shrink) S + shrink D, with D the diagonal of the pooled covariance and a small ridge.
    ``scale`` flattens the log density difference, which is too sure of itself where statistics aren't quite normal. With
    fewer than two rows in a class there is nothing to tell apart, and every score is the smoothed share of class 1.
    """
    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r["label"]: r for r in rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *sums, *products).collect()}
    n = [found[k]["n"] if k in found else 0 for k in (0, 1)]
    prior = (n[1] + 0.5) / (n[0] + n[1] + 1)
    if min(n) < 2:
        return Discriminant(prior)
    means, spreads = [], []
    for k in (0, 1):
        mean = np.array([found[k][f"s{i}"] for i in range(d)]) / n[k]
        square = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                square[i, j] = square[j, i] = found[k][f"p{i}_{j}"]
        means.append(mean)
        spreads.append(square / n[k] - np.outer(mean, mean))
    pooled = np.diag((n[0] * np.diag(spreads[0]) + n[1] * np.diag(spreads[1])) / sum(n) + 1e-4)
    roots = [np.linalg.cholesky((1 - shrink) * s + shrink * pooled) for s in spreads]
    volume = [2 * np.log(np.diag(r)).sum() for r in roots]
    shift = 0.5 * (volume[0] - volume[1]) + np.log(n[1] / n[0])
    return Discriminant(prior, tuple(means), tuple(np.linalg.inv(r) for r in roots), float(shift), scale)


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``rows`` of ``with_features`` as (doc_id, score)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            x = np.asarray(x.flatten()).reshape(len(x), -1) if len(x) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(apply, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str | Column) -> Column:
    """Rows that training leaves out: crc32 of the id as text is a multiple of 5. A null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quality(measured: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``measured``, a written table of ``with_features``.

    ``labels`` is (doc_id, quality); rows with a null in either and labels other than 0 and 1 teach nothing, a repeated
    label counts once. Held-out ids teach nothing.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)").distinct()
    known = known.where(~held_out("doc_id"))
    scored = score(measured, fit(measured.join(known, "doc_id")))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)
