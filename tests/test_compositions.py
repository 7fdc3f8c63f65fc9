"""Enrichment, plans from a model that fails, reports of runs, the search tool."""

import json
import re
from collections import Counter

from loomstone.functions.text import STOP_WORDS
from loomstone.operators import enrich as N
from loomstone.operators import evaluation as V
from loomstone.operators import pii
from loomstone.operators import planning as P
from loomstone.plans import registry
from loomstone.plans import search as S


def test_enrich(spark):
    long = "The river rises. River water is cold; cold water. Mail jane.doe@example.com, effective from 2024-05-06 until 7 June 2025."
    docs = [(1, long), (2, long), (3, None), (4, "Valid from: 2024-05-06, expires on 1 May 2024."), (5, "Der Fluss und die Stadt sind nicht weit von der Grenze und dem Wald.")]
    got = {r.id: r for r in N.enrich(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1][1:] == got[2][1:]
    assert "jane" not in got[1].text and got[1].pii_types == ["EMAIL_ADDRESS"]
    assert (str(got[1].effective_from), str(got[1].effective_to)) == ("2024-05-06", "2025-06-07")
    assert (str(got[4].effective_from), got[4].effective_to) == ("2024-05-06", None)
    assert got[5].lang == "de" and got[3].text == "" and got[3].keywords == []
    words = [w for w in re.findall(r"[^\W\d_]{3,}", got[1].text.lower()) if w not in STOP_WORDS]
    order = sorted(Counter(words).items(), key=lambda x: (-x[1], words.index(x[0])))
    assert got[1].keywords == [w for w, _ in order[:10]] and got[1].keywords[:3] == ["river", "water", "cold"]


def test_enrich_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["enrich_doc"](spark, sf).collect():
        head = {0: "Effective from 2024-05-06, valid until 7 June 2025. ", 1: "Valid from: 2024-05-06 until 1 May 2024. "}.get(r.doc_id % 4, "")
        assert r.pii_types == ",".join(sorted({m[0] for m in pii.analyse(head + texts[r.doc_id])}))
        assert (r.effective_from, r.effective_to) == {0: ("2024-05-06", "2025-06-07"), 1: ("2024-05-06", None)}.get(r.doc_id % 4, (None, None))


def test_transform(spark):
    def ask(texts):
        if any("fail" in x for x in texts):
            raise TimeoutError("no answer")
        if any("short" in x for x in texts):
            return []
        return [json.dumps({"rewritten": x.upper(), "confidence": 0.5}) if "odd" not in x else "not JSON" for x in texts]

    m = spark.createDataFrame([(k, x) for k, x in enumerate(["one", "fail now", "odd", "short", None, "six"])], "id long, message string").coalesce(1)
    got = {r.id: (r.rewritten, r.degraded) for r in P.transform(m, ask, keep=("id",), batch=1).collect()}
    assert got == {0: ("ONE", False), 1: ("fail now", True), 2: ("odd", True), 3: ("short", True), 4: ("", False), 5: ("SIX", False)}
    got = {r.id: (r.rewritten, r.degraded) for r in P.transform(m, ask, keep=("id",), batch=6).collect()}
    assert all(d for _, d in got.values())  # a call is lost as a whole
    assert all(r.degraded for r in P.transform(m, keep=("id",)).collect())


RULES = [V.Limit("leak", 0.5, True), V.Limit("faith", 0.8), V.Limit("slow", 10.0, upper=True)]


def items(spark, leak):
    rows = [(1, "a", leak, 0.9, 5.0, 0.1, True), (2, "a", 1.0, None, 20.0, 0.2, False), (3, None, 1.0, 0.2, 1.0, 0.3, True)]
    return spark.createDataFrame(rows, "item_id long, category string, leak double, faith double, slow double, cost double, passed boolean")


def test_report(spark, tmp_path):
    before = spark.createDataFrame([(1, False), (2, True), (4, True)], "item_id long, passed boolean")
    lines = {(r.section, r.pos): r.line for r in V.report(items(spark, 1.0), before, RULES, k=2).collect()}
    assert lines["1 verdict", 1] == "# Evaluation: passed with warnings"
    assert [lines["2 gate", k] for k in (1, 2, 3)] == ["| faith | 0.5500 | ≥ 0.8 | FAIL |", "| leak | 1.0000 | ≥ 1.0 | pass |", "| slow | 8.6667 | ≤ 10.0 | pass |"]
    assert [lines["4 changes", k] for k in (1, 2, 3, 4)] == ["| fixed | 1 |", "| missing | 1 |", "| new | 1 |", "| regression | 1 |"]
    assert [lines["5 worst", k] for k in (1, 2)] == ["| 2 | FAIL | 1.0000 | – | 20.0000 |", "| 3 | pass | 1.0000 | 0.2000 | 1.0000 |"]
    assert {lines["3 categories", k] for k in (1, 2)} == {"| a | 2 | 0.5000 | 1.0000 | 0.9000 | 12.5000 |", "| – | 1 | 1.0000 | 1.0000 | 0.2000 | 1.0000 |"}
    failed = V.report(items(spark, 0.9), before, RULES)  # a hard limit is never below 1
    assert failed.where("section = '1 verdict'").first().line == "# Evaluation: failed"
    V.write_report(failed, f"file://{tmp_path}/r")
    text = [r.value for r in spark.read.text(f"{tmp_path}/r/markdown").collect()]
    assert text[0] == "# Evaluation: failed" and len(text) == failed.count() == spark.read.json(f"{tmp_path}/r/json").count()


def test_gate_and_failures(spark):
    i = items(spark, 0.9)
    assert {r.metric: r.passed for r in V.gate(i, RULES).collect()} == {"leak": False, "faith": False, "slow": True}
    assert {tuple(r) for r in V.item_failures(i, RULES).collect()} == {(1, "leak"), (3, "faith"), (2, "slow")}
    assert {r.metric: r.passed for r in V.gate(i.where("false"), RULES).collect()} == dict.fromkeys(("leak", "faith", "slow"), True)  # unmeasured passes


def test_search_tool_stays_within_its_caller(spark, sf):
    may = {(r.persona, r.doc_id) for r in registry.queries()["acl_filter"](spark, sf).collect()}
    who = {q: p for q, p, *_ in S.SEARCHES}
    rows = registry.queries()["tool_search"](spark, sf).collect()
    assert rows and all((who[r.call], r.id) in may for r in rows)
