from __future__ import annotations

from text_cases import table

from tidetrace.llm import decontaminate


def test_excerpt_of_long_item(spark, tmp_path):
    """A verbatim excerpt is found however long its item is; a few words in a row aren't one."""
    item = [f"w{i}" for i in range(400)]
    docs = [(1, item[100:250]), (2, item[380:393]), (3, item[20:32]), (4, ["x"])]
    docs = [(d, " ".join([*"abc", *words, *"def"])) for d, words in docs]
    docs = table(spark, docs, "doc_id long, text string", tmp_path)
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.score, r.first_word, r.last_word) for r in decontaminate.find_passages(docs, bench).collect()}
    assert found == {1: (150 / 400, 3, 152), 2: (13 / 400, 3, 15)}


def test_every_third_word_replaced(spark, tmp_path):
    """Copies that the alignment accepts are found without four words in a row."""
    item = [f"w{i}" for i in range(24)]
    docs = [(k, " ".join("x" if i % k == k - 1 else w for i, w in enumerate(item))) for k in (3, 4)]
    docs = table(spark, docs, "doc_id long, text string", tmp_path)
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_passages(docs, bench).collect()} == {3, 4}
