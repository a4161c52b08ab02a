"""Remove lines or paragraphs that occur before in the collection.

A unit's text is normalised (lower case, runs of white space as one blank) and hashed. Digests are grouped over the whole
collection, after a grouping in each task; the occurrence with the smallest rank stays and the rest are removed, each with
its place in the original text. Units leave the task that reads them as digests only, and only what is removed goes back
to the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm.common import free_name, with_scan_id, written

_SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[\x20\x09-\x0D]*\n)+")}


def units_of(text: str | None, unit: str = "line", min_words: int = 1) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text that have at least ``min_words`` words; offsets in code points.

    A unit ends before its separator: a line feed, or one or more blank lines for paragraphs. Null has no units.
    """
    if not text:
        return []
    found, start = [], 0
    for end, following in [*((m.start(), m.end()) for m in _SEPARATORS[unit].finditer(text)), (len(text), 0)]:
        words = text[start:end].lower().split()
        if len(words) >= min_words:
            found.append((start, end, len(words), hashlib.md5(" ".join(words).encode(), usedforsecurity=False).digest()))
        start = following
    return found


def read_units(documents: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """``row, doc_id, n, start, end, words, high, low``: the n-th unit (from 0) of each row, its place, its words and its 128-bit
    digest. Without a column ``row`` in ``documents`` it is null."""
    row = F.col("row") if "row" in documents.columns else F.lit(None)
    rows = documents.select("doc_id", "text", row.cast("bigint").alias("row"))
    numbers = [T.StructField(c, T.LongType()) for c in ("n", "start", "end", "words", "high", "low")]
    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"], *numbers])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for n, (start, end, words, digest) in enumerate(units_of(text, unit, min_words)):
                    of.append(row)
                    halves = (int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))
                    found.append((n, start, end, words, *halves))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 6
            place = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(place), batch.column(0).take(place), *columns], schema.names)

    return rows.mapInArrow(cut, schema)


def repeated_units(documents: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """The units to remove: ``row, doc_id, start, end, words, n_copies``, the number of equal units, and ``kept_doc_id, kept_start``.

    ``documents`` is (doc_id, text), with a number ``row`` of each row if texts are to be cut afterwards. The rank of an occurrence is
    (doc_id, start), null ids last; the smallest stays. Units with the same id, place and text (repeated rows) are one occurrence,
    so that a row's copy doesn't remove the row. Units under ``min_words`` words, blank ones always, are left alone. Empty
    input gives an empty result.
    """
    units = written(read_units(documents, unit, max(min_words, 1)), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start")
    kept = units.groupBy("high", "low").agg(F.min(rank).alias("kept"), F.max(rank).alias("last"), F.count("*").alias("n_copies"))
    # as a table: a join of two tables can split the rows of a digest that most documents have
    kept = written(kept.where("kept < last").drop("last"), "kept")
    found = units.join(kept, ["high", "low"]).withColumn("rank", rank).where("rank > kept")
    place = [F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")]
    return found.select("row", "doc_id", "start", "end", "words", "n_copies", *place)


def remove_units(documents: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """``documents``, a scanned table with ``doc_id`` and ``text``, a row each without its repeated units; what stands between them
    stays, separators included. Other columns, whatever their names, stay.

    Added are ``removed``, the spans in the original text in order, each with ``start, end, words, n_copies, kept_doc_id,
    kept_start`` (empty where nothing is removed), with an underscore if that name is taken. A null text stays null.
    """
    row, spans = free_name(documents, "_row"), free_name(documents, "removed")
    rows = with_scan_id(documents, row)
    found = repeated_units(rows.select(F.col(row).alias("row"), "doc_id", "text"), unit, min_words)
    span = F.struct("start", "end", "words", "n_copies", "kept_doc_id", "kept_start")
    # spans meet by row, whose text they are part of
    found = written(found.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(span)).alias(spans)), "removed")
    joined = rows.join(found, row, "left")
    # what is kept begins where a span ends, and ends where the next one starts
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s.end))
    ends = F.concat(F.transform(spans, lambda s: s.start), F.array(F.length("text").cast("bigint")))
    parts = F.zip_with(begins, ends, lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    none = F.array().cast(found.schema[spans].dataType)
    return joined.withColumn("text", text).withColumn(spans, F.coalesce(spans, none)).select(*documents.columns, spans)
