from loomstone.operators import guardrails as G


def test_short_passages(spark):
    long = "".join(chr(97 + k * k % 23) for k in range(100))
    docs = spark.createDataFrame([(1, "Some text. A short, ITEM here"), (2, "none " + long[30:90]), (3, "other"), (4, "x" * 60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a short item"), (2, long), (3, " ?! "), (4, "x" * 60), (5, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in G.leaked(docs, items).collect()} == {(1, 1), (2, 2), (4, 4)}
