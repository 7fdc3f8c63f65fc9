"""Pairs of conflicting candidates against brute force over all pairs of a pool."""

import math
import random
import re
from collections import Counter, defaultdict

from loomstone.functions.text import STOP_WORDS
from loomstone.operators import conflicts as N
from loomstone.operators import folds

SCHEMA = "grp long, id long, document long, score double, text string, effective long, modified long, authority int, seen long"


def candidates():
    rnd = random.Random(8)
    subjects = [("travel", "allowance"), ("meal", "refund"), ("parking", "permit"), ("visitor", "badge")]
    rows = []
    for grp in range(8):
        for k in range(rnd.choice((1, 5, 14, 40))):
            a, b = rnd.choice(subjects)
            extra = " ".join(rnd.choice("amber birch cedar delta ember fjord".split()) for _ in range(rnd.choice((0, 1, 6))))
            text = rnd.choice([f"The {a} {b} limit equals {rnd.choice((10, 20))} EUR {extra}", f"Every {a} {b} must {rnd.choice(('', 'not '))}be shown {extra}", f"{a} {b} {extra}", None if k % 9 == 8 else extra])
            rows.append((grp, grp * 100 + k, rnd.choice((1, 1, 2, 3, 4, 5, 6, None)), rnd.choice((0.5, 0.25, 1.0, None)), text, None, rnd.choice((1, 200)) * 86_400, 1, k))
    return rows


def slow(rows, pool, most, least):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for grp, own in by.items():
        own = sorted(own, key=lambda r: (-(r[3] or 0.0), r[1]))[:pool]
        terms = [{w for w in re.findall(r"[^\W\d_]{3,}", (r[4] or "").lower()) if w not in STOP_WORDS} for r in own]
        df = Counter(t for ts in terms for t in ts)
        idf = {t: math.log(1 + len(own) / (1 + n)) for t, n in df.items()}
        mass = [sum(idf[t] for t in ts) for ts in terms]
        like = {(i, j): sum(idf[t] for t in terms[i] & terms[j]) / min(mass[i], mass[j]) for i in range(len(own)) for j in range(i + 1, len(own)) if terms[i] & terms[j]}
        root = list(range(len(own)))

        def find(k):
            return k if root[k] == k else find(root[k])  # noqa: B023

        for (i, j), x in like.items():
            if x >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        groups = defaultdict(list)
        for k in range(len(own)):
            groups[find(k)].append(k)
        kept = sorted((g for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), g[0]))[: N.CLUSTERS]
        pairs = {(i, j) for g in kept for i in g for j in g if i < j}
        pairs |= {p for p, x in like.items() if N.HALF * least <= x < least and folds.conflict(own[p[0]][4] or "", own[p[1]][4] or "")[0] != "none"}
        pairs = [(-((own[i][3] or 0.0) + (own[j][3] or 0.0)), i, j) for i, j in pairs if own[i][2] is not None and own[j][2] is not None and own[i][2] != own[j][2]]
        for rank, (total, i, j) in enumerate(sorted(pairs)[:most], 1):
            out[grp, rank] = (own[i][1], own[j][1], -total, *folds.conflict(own[i][4] or "", own[j][4] or ""))
    return out


def test_pairs(spark):
    df = spark.createDataFrame(candidates(), SCHEMA)
    kinds = set()
    for pool, most in ((30, 4), (10, 2), (40, 7)):
        got = {(r.grp, r["rank"]): (r.a, r.b, r.total, r.kind, r.confidence) for r in N.conflict_pairs(df, pool, most).collect()}
        assert got == slow(candidates(), pool, most, N.LIKE)
        kinds |= {v[3] for v in got.values()}
    assert kinds == {"numeric", "polarity", "none"}


def test_check(spark):
    rows = [
        (1, 1, 1, 0.9, "The daily travel limit equals 50 EUR", None, 0, 1, 0),
        (1, 2, 2, 0.8, "The daily travel limit equals 60 EUR", None, 200 * 86_400, 1, 0),
        (1, 3, 2, 0.7, "The daily travel limit equals 70 EUR", None, 0, 1, 0),
        (2, 4, 1, 0.9, "Staff must file reports", 86_400, 0, 1, 0),
        (2, 5, 2, 0.8, "Staff must not file reports", None, 0, 1, 0),
        (3, 6, 1, 0.8, "Alone", None, 0, 1, 0),
    ]
    got = {(r.grp, r["rank"]): r for r in N.conflict_check(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (r.current, r.other, r.kind, r.basis, r.superseded) for k, r in got.items()} == {(1, 1): (2, 1, "numeric", "modified", True), (1, 2): (1, 3, "numeric", "indeterminate", False), (2, 1): (4, 5, "polarity", "indeterminate", False)}
    assert got[1, 1].note == "[2] is current (by modified, 200.0 days apart); [1] is superseded and must be cited for the disagreement."


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.conflict_check(none).collect() == [] == N.conflict_pairs(none).collect()


def test_queries(spark, sf):
    from loomstone.plans import registry

    pairs = registry.queries()["conflict_pairs"](spark, sf).collect()
    check = registry.queries()["conflict_check"](spark, sf).collect()
    assert pairs and check and max(r["rank"] for r in pairs) <= N.PAIRS
    assert {(r.grp, *sorted((r.current, r.other))) for r in check} == {(r.grp, *sorted((r.a, r.b))) for r in pairs if r.kind != "none"}
