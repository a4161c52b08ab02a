"""Words and runs of words of many texts at once, as 64-bit hashes.

Texts stay in Arrow's buffer of bytes. A polynomial prefix sum over the bytes gives the hash of every word without a loop, a
weighted sum of neighbouring words that of every run. The functions use wrap-around arithmetic modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Taken as blank where punctuation doesn't count: all of ASCII but letters and digits.
BARE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of texts worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all of its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


@dataclass
class Words:
    """The words of the texts ``first`` to ``first + len(bounds) - 2`` of a batch.

    Word i has the hash ``hashes[i]`` and the bytes ``starts[i]`` to ``ends[i]`` of ``data``; text j has the words
    ``bounds[j]`` to ``bounds[j + 1]`` and begins at byte ``origins[j]``.
    """

    first: int
    data: np.ndarray
    origins: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def words(texts: pa.Array, blank: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of all texts, piece by piece, A-Z as a-z; ``blank`` are the bytes between words. A null text has none."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    whole = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        origins = offsets[first : last + 1] - offsets[first]
        yield _words(first, whole[offsets[first] : offsets[last]], origins, blank)
        first = last


def _words(first: int, data: np.ndarray, origins: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    blank = np.ones(n + 2, bool)
    blank[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[origins] = True
    inner = ~blank[1:-1]
    starts = np.flatnonzero(inner & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(inner & (blank[2:] | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    codes = _LOWER[data].astype(np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n), out=sums[1:], dtype=np.uint64)
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts])
    return Words(first, data, origins, np.searchsorted(starts, origins), starts, ends, hashes)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` hashes; one fewer than ``size`` fewer than there are hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += hashes[k : n + k] * _WEIGHTS[k]
    return mix(out)


def shingle_sets(piece: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct runs of ``size`` words of each text of a piece; a shorter text has all its words as its only run."""
    every = runs(piece.hashes, size)
    out = []
    for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(runs(piece.hashes[a:b], b - a) if b > a else every[:0])
    return out
