from collections import Counter

import numpy as np

from loomstone.llm import jaccard_join as J


def test_order_by_exact_counts(spark):
    """Tokens stand by the number of sets that have them, counted exactly."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.choice(common, min(n, 9), replace=False)])) for n in (1, 3, 50, 700, 700)] + [common[:3]]
    sets = [np.sort(s) for s in sets]
    held = Counter(x for s in sets for x in s.tolist())
    whole = spark.createDataFrame([(k - 3, s.tobytes()) for k, s in enumerate(sets)], "s1 long, tokens binary")
    got = {r.s1: np.frombuffer(r.tokens, dtype=np.uint64) for r in J.rare_first(spark, whole, 5 * J.TOKENS_A_BUCKET).collect()}
    for k, s in enumerate(sets):
        want = sorted(s.tolist(), key=lambda x: (held[x], int(J.mixed(np.array([x], np.uint64), 41)[0])))
        assert got[k - 3].tolist() == want
    assert len(got) == len(sets) and max(held.values()) > 1


def test_passage_of_few_documents_makes_no_family(spark, monkeypatch):
    """Texts that share a tenth of their words only are in no family; a copy with one more word is."""
    rng, seen = np.random.default_rng(6), []
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passages = [words(60) for _ in range(20)]
    rows = [(k, " ".join([*words(300), *passages[k % 20], *words(200)])) for k in range(100)]
    rows += [(100, rows[0][1] + " more")]
    real = J.linked_families
    monkeypatch.setattr(J, "linked_families", lambda members, *a: seen.append(members.count()) or real(members, *a))
    got = {r.doc_id: r.component_id for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(100)} | {100: 0} and seen == [2]
