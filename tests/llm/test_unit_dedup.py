from __future__ import annotations

from collections import defaultdict

import pytest
from text_cases import ODD, SCHEMA, table
from pyspark.sql import functions as F

from tidetrace.llm import unit_dedup

A = "this line has more than eight words in it for sure"
B = "another line that has more than eight words as well"
ROWS = [
    (3, f"short\n{A}\n\n{B}"),
    (1, f"{B}\n{A.upper()}  \nshort"),
    (2, f"é {A}\n{A}\n  {A} \n{A}"),
    (None, f"{A}\nshort"),
    (4, f"only {B} here"),
    (4, f"only {B} here"),
]


def brute(rows, unit, min_words=1):
    places = defaultdict(set)
    for doc, text in rows:
        for start, end, _, digest in unit_dedup.units_of(text, unit, min_words):
            places[digest].add((doc is None, doc, start, end))
    out = set()
    for found in places.values():
        first, *rest = sorted(found, key=lambda p: (p[0], p[1] or 0, p[2]))
        out |= {(p[1], p[2], p[3], first[1], first[2]) for p in rest}
    return out


@pytest.mark.parametrize("unit, floor", [("line", 1), ("paragraph", 1), ("line", 8)])
def test_against_brute(spark, tmp_path, unit, floor):
    docs = table(spark, ROWS, "doc_id long, text string", tmp_path)
    got = unit_dedup.repeated_units(docs, unit, floor)
    assert {(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in got.collect()} == brute(ROWS, unit, floor)
    texts = dict(ROWS)
    for r in got.where("doc_id is not null").collect():
        assert len(texts[r.doc_id][r.start : r.end].split()) == r.words >= floor


def test_units():
    text = "a b\n\n \nc d é\ne\n\nf"
    assert [(s, e) for s, e, _, _ in unit_dedup.units_of(text, "line", 1)] == [(0, 3), (7, 12), (13, 14), (16, 17)]
    assert [text[s:e] for s, e, _, _ in unit_dedup.units_of(text, "paragraph", 1)] == ["a b", "c d é\ne", "f"]
    assert unit_dedup.units_of(None) == unit_dedup.units_of("") == []


def test_remove(spark, tmp_path):
    """Units of any length go, in rows with null or repeated ids too, and say where they were."""
    docs = table(spark, ROWS, "doc_id long, text string", tmp_path).withColumn("start", F.lit("clash"))
    left = unit_dedup.remove_units(docs)
    assert left.columns == [*docs.columns, "removed"]
    rows = left.collect()
    same = f"only {B} here"
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted(
        [("1", ROWS[1][1]), ("2", f"é {A}\n\n\n"), ("3", "\n\n\n"), ("None", "\n"), ("4", same), ("4", same)]
    )
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        cut = [(s.start, s.end) for s in r.removed]
        whole = "".join(c for i, c in enumerate(texts[r.doc_id]) if not any(a <= i < b for a, b in cut))
        assert whole == r.text
        assert all(texts[s.kept_doc_id][s.kept_start :].lower().split()[: s.words] == texts[r.doc_id][s.start : s.end].lower().split() for s in r.removed)


def test_odd_rows(spark, tmp_path):
    docs = table(spark, ODD, SCHEMA, tmp_path / "a").withColumn("end", F.lit(0)).withColumn("removed", F.lit(0)).withColumn("_row", F.lit(0))
    assert sorted(r.doc_id is None for r in unit_dedup.repeated_units(docs).collect()) == [True]
    left = unit_dedup.remove_units(docs).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(r[0]), str(r[1]) if r[0] else "") for r in ODD)
    assert unit_dedup.remove_units(table(spark, [], SCHEMA, tmp_path / "b")).collect() == []
