"""Small tables that hold the odd cases."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

#: (doc_id, text, lang, source, n_chars): nulls everywhere, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 10),
    (1, "one two three four five six seven eight nine ten", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n\x0b ", "en", "b", 5),
    (None, "one two three four five six seven eight nine ten", "en", None, 3),
    (5, LONG, "xx", "a", len(LONG)),
    (6, "short", None, "c", 5),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, schema, path):
    """The rows as a table that is read from two files."""
    spark.createDataFrame(rows, schema).repartition(2).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
