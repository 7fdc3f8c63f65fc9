"""No query is answered from what its persona may not read."""

from collections import defaultdict

from loomstone.operators import search as S
from loomstone.plans import registry
from loomstone.plans import search as P


def test_results_are_what_the_persona_may_read(spark, sf):
    may = defaultdict(set)
    for r in registry.queries()["acl_filter"](spark, sf).collect():
        may[r.persona].add(r.doc_id)
    persona = {q: p for q, p, _ in P.ASKED}
    for name in ("hybrid_rrf", "retrieve"):
        rows = registry.queries()[name](spark, sf).collect()
        assert rows and all(r.id in may[persona[r.query]] for r in rows)
    assert not may["intern"] >= may["engineer"]  # the engineer has more to leak


def test_a_private_document_changes_nothing_for_others(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "alpha " * 50 + "secret")], "doc_id long, text string")
    rights = lambda more: spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), *more], "persona string, id long")
    queries = spark.createDataFrame([(1, "x", "alpha"), (1, "x", "secret"), (2, "y", "secret"), (3, "z", "alpha")], "query long, persona string, term string")
    with_it = [sorted(map(tuple, b.collect())) for b in S.search_as(queries, S.term_counts(docs), rights([]))]
    without = [sorted(map(tuple, b.collect())) for b in S.search_as(queries.where("query = 1"), S.term_counts(docs.where("doc_id < 3")), spark.createDataFrame([("x", 1), ("x", 2)], "persona string, id long"))]
    for a, b in zip(with_it, without, strict=True):
        assert [r for r in a if r[0] == 1] == b and {r[:2] for r in a} == {(1, 1), (1, 2), (2, 3)}


def test_scans(spark, sf, capsys):
    """The texts are read once: what the plan of the result reads is staged."""
    from loomstone.plans.base import Tables

    docs = Tables(spark, sf).documents
    S.term_counts(docs).explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    registry.queries()["hybrid_rrf"](spark, sf).explain()
    assert capsys.readouterr().out.count("FileScan") == 0
