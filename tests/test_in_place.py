"""Words are counted where their texts are: what is shuffled is small, and results are as counted by hand."""

import math
import re
from collections import Counter
from hashlib import md5

from loomstone.functions.text import STOP_WORDS
from loomstone.operators import enrich, search
from loomstone.plans import registry

ROWS = [(1, "Blue tree blue sky the tree"), (2, None), (3, "gold"), (3, "tree gold tree"), (None, "alpha beta"), (None, "beta"), (4, "12 -- ")]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def by_id(pattern):
    own = {}
    for i, text in ROWS:
        own.setdefault(i, []).extend(re.findall(pattern, (text or "").lower()))
    return own


def test_keywords_are_counted_in_their_rows(spark, sf):
    assert exchanges(registry.queries()["insights_heur"](spark, sf)) == 0
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {}
    for r in enrich.keyword_counts(docs, k=2).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.word, r.n, r.place))
    want = {}
    for i, words in by_id("[a-z]{3,}").items():
        if top := Counter(w for w in words if w not in STOP_WORDS).most_common(2):
            want[i] = [(w, n, k) for k, (w, n) in enumerate(top, 1)]
    assert {i: dict((w, n) for w, n, _ in x) for i, x in got.items() if i != 3} == {i: dict((w, n) for w, n, _ in x) for i, x in want.items() if i != 3}
    assert got[1] == want[1] and sorted(w for w, *_ in got[3]) == ["gold", "tree"]


def test_vectors_move_terms_once_and_weights_once(spark, sf):
    assert exchanges(registry.queries()["embed_tfidf"](spark, sf)) == 2
    for rows in (ROWS, ROWS[:3]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        own = {}
        for i, text in rows:
            own.setdefault(i, Counter()).update(re.findall(r"\w+", (text or "").lower()))
        df, want = Counter(t for c in own.values() for t in c), {}
        for i, c in own.items():
            for t, n in c.items():
                key = (i, int(md5(t.encode()).hexdigest()[:6], 16) % 512)
                want[key] = want.get(key, 0) + n * (math.log((len(rows) + 1) / (df[t] + 1)) + 1)
        norm = Counter()
        for (i, _), w in want.items():
            norm[i] += w * w
        got = {(r.id, r.bucket): r.w for r in search.tfidf(docs).collect()}
        assert got.keys() == want.keys() and all(abs(w - want[k] / math.sqrt(norm[k[0]])) < 1e-9 for k, w in got.items())


def test_terms_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert exchanges(search.term_counts(docs.where("doc_id < 3"))) == 0
    got = {(r.id, r.term): (r.tf, r.dl) for r in search.term_counts(docs).collect()}
    assert got[1, "tree"] == (2, 6) and got[3, "tree"] == (2, 3) and got[None, "beta"] == (2, 2) and got[2, None][0] == 1
