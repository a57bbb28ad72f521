from brindle.llm import decontam as D


def test_items_without_an_id_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of the kind in this text"), (3, other)], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, other), (7, "some item that no document has")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.similarity) for r in D.matches(docs, items).collect()} == {(1, None, 1.0), (3, None, 1.0)}
    assert [r.doc_id for r in D.keep_clean(docs, items).collect()] == [2]
