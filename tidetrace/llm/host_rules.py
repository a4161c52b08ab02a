"""Quality rules with verdicts on hosts.

Rules are checked on every document. Their failures are counted by host; a host's failure rate of each rule is shrunk
towards the rate of all hosts by a beta prior that is fitted to the hosts' rates, so that a host with few documents is not
judged by chance. Hosts with a shrunk rate above a limit are rejected, and their verdict goes back to their documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm.common import WORD, free_name

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]+")
#: What takes a line to be blank: the characters between words.
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

#: Rules that count towards a host's verdict besides the base rules, as SQL over the statistics.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "long_words": "word_chars > 20 * n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
}
BASE = ("short", "repeats")


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The statistics of one text, in the order of ``STATS``; null and empty texts have zeros.

    ``word_chars`` counts code points in words, ``n_symbols`` the characters ``#*$%&|<>``, ``n_dup_lines`` the lines with a
    word that equal an earlier line, ``n_repeat_words`` the words in three-word windows that occur twice or more.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    n = len(words)
    dups = 0
    if "\n" in text:
        lines = Counter(text.split("\n"))
        if len(lines) <= text.count("\n"):
            dups = sum(c - 1 for line, c in lines.items() if c > 1 and line.strip(_BLANK))
    repeats = 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if len(windows) < n - 2:
        end = 0  # words before it are counted
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            if windows[window] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return n, sum(map(len, words)), sum(map(len, _SYMBOL.findall(text))), dups, repeats


def with_stats(documents: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of the documents, then the statistics of their texts in columns named as in ``STATS``.

    A kept column with the name of a statistic is refused: leave it out, or rename it before.
    """
    if clash := {c.lower() for c in keep} & set(STATS):
        raise ValueError(f"columns have the names of statistics: {sorted(clash)}")
    at = len(keep)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [text_stats(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)] or [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], [*keep, *STATS])

    rows = documents.select(*keep, F.col(text).alias(free_name(documents, "_text")))
    kept = rows.schema.fields[:at]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in STATS)])
    return rows.mapInArrow(measure, schema)


def base_failed() -> Column:
    return F.expr(" or ".join(f"({RULES[r]})" for r in BASE))


def host_verdicts(stats: DataFrame, host: str, limit: float = 0.5) -> DataFrame:
    """``host``, ``n_docs``, a shrunk failure rate ``rate_<rule>`` for each rule, and ``host_failed``: one of them is over ``limit``.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates (each host's rate weighs the
    same; the variance is what remains after that of drawing the documents, and at least a ten-thousandth of its maximum). A
    host's rate becomes (failures + a) / (documents + a + b). Documents with a null host are judged as one host.
    """
    counts = [F.sum(F.expr(f"cast({rule} as bigint)")).alias(f"bad_{name}") for name, rule in RULES.items()]
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *counts)
    moments = []
    for name in RULES:
        rate = F.col(f"bad_{name}") / F.col("n_docs")
        moments += [F.avg(rate).alias(f"mean_{name}"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias(f"var_{name}")]
    prior = hosts.agg(*moments, F.avg(1 / F.col("n_docs")).alias("per_doc"))
    hosts = hosts.join(prior)  # one row
    rates = {}
    for name in RULES:
        mean = F.least(F.greatest(F.col(f"mean_{name}"), F.lit(1e-6)), F.lit(1 - 1e-6))
        most = mean * (1 - mean)
        spread = F.greatest(F.col(f"var_{name}") - most * F.col("per_doc"), most * 1e-4)
        size = F.greatest(most / F.least(spread, most * 0.9999) - 1, F.lit(1e-3))
        rates[f"rate_{name}"] = (F.col(f"bad_{name}") + mean * size) / (F.col("n_docs") + size)
    hosts = hosts.withColumns(rates)
    failed = F.greatest(*rates) > limit
    return hosts.select("host", "n_docs", *rates, failed.alias("host_failed"))


def judge(stats: DataFrame, host: str, limit: float = 0.5) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``: the base rules hold and the host is not rejected.

    ``stats`` is a written table: it is read for the counts and again for the verdicts. An empty table gives an empty result.
    """
    name = free_name(stats, "_host")
    verdicts = host_verdicts(stats, host, limit).select(F.col("host").alias(name), "host_failed")
    joined = stats.join(verdicts, F.col(host).eqNullSafe(F.col(name)), "left").drop(name)
    joined = joined.withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host_failed")
