"""Find secrets in texts.

One Aho-Corasick pass over a text finds keywords; only there, an anchored pattern decides, and where a token format carries
a checksum, the checksum too. Runs of hex digits have no keyword and are found by their own pattern.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Token formats as their issuers publish them.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
GOOGLE = re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")
SLACK = re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}")
JWT = re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+")
STRIPE = re.compile(r"(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Kinds in the order in which spans with the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "private_key", "google", "slack", "jwt", "stripe")

#: Keyword in lower case -> kind.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "-----begin ": "private_key",
    "aiza": "google",
    **dict.fromkeys(("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "slack"),
    "eyj": "jwt",
    **dict.fromkeys(("sk_live_", "sk_test_", "rk_live_", "rk_test_"), "stripe"),
}


def _checksum(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the token's body in base 62."""
    rest, digits = zlib.crc32(match[1].encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits == match[2]


#: Kind -> (pattern, what a match must meet). The pattern of a base kind takes up its whole match even where that is refused.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "github": (GITHUB, _checksum),
    "npm": (NPM, _checksum),
    "private_key": (PRIVATE, None),
    "google": (GOOGLE, None),
    "slack": (SLACK, None),
    "jwt": (JWT, None),
    "stripe": (STRIPE, None),
}


@lru_cache(maxsize=1)
def _keywords():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of a text in code points, by start and then by the order of ``KINDS``.

    Matches of a kind don't overlap and are found from the left; those of different kinds may overlap. Null has none.
    """
    if not text:
        return []
    found = [(*m.span(), "hex") for m in HEX.finditer(text)]
    upto: dict[str, int] = {}
    # bytes.lower changes A-Z only, so code points stay in place
    for last, (length, kind) in _keywords().iter(text.encode().lower().decode()):
        start = last - length + 1
        if start < upto.get(kind, 0):
            continue
        pattern, accept = RULES[kind]
        if match := pattern.match(text, start):
            upto[kind] = match.end()
            if accept is None or accept(match):
                found.append((*match.span(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``id_column`` and ``found``, an array of (start, end, kind) as ``find_spans`` gives it."""
    rows = documents.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [
                [{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t)] for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], ["_id", "found"])

    schema = f"_id {kind}, found array<struct<start: bigint, end: bigint, kind: string>>"
    return rows.mapInArrow(scan, schema).withColumnRenamed("_id", id_column)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, and all spans as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s.kind.isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
