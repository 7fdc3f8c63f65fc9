"""Consolidation against the fold and the pass in Python, and rounds over a user that one task would not hold."""

import random
from collections import defaultdict

import numpy as np
import pytest

from loomstone.operators import consolidate as C

DAY, NOW = 86_400, 1_000 * 86_400


def fold(rows, like):
    """(user, id) -> what it goes into; rows of (user, id, kind, vector, salience)."""
    out, kept = {}, defaultdict(list)
    unit = lambda v: np.asarray(v, np.float64) / max(1e-12, np.linalg.norm(v))
    for user, i, kind, v, s in sorted(rows, key=lambda r: (r[0], -(r[4] or 0.0), r[1])):
        if not v:
            out[user, i] = i
            continue
        u = unit(v)
        out[user, i] = next((j for j, w in kept[user, kind] if w @ u >= like), i)
        if out[user, i] == i:
            kept[user, kind].append((i, u))
    return out


def vectors(rnd, n, centres, noise):
    c = rnd.standard_normal((centres, 24))
    v = c[rnd.integers(0, centres, n)] + noise * rnd.standard_normal((n, 24))
    return v.astype(np.float32).tolist()


def test_small_users(spark):
    rnd = np.random.default_rng(1)
    v = vectors(rnd, 300, 20, 0.25) + [[], None]
    v[7] = v[3]
    rows = [(k % 7, k, "fact" if k % 3 else "task", x, None if k % 50 == 9 else float(rnd.integers(0, 5)) / 4) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "user long, id long, kind string, vector array<float>, salience double")
    for small in (2048, 4):  # in tasks of their own, and by rounds
        got = {(r.user, r.id): r.into for r in C.merged_into(df, 0.9, small).collect()}
        assert got == fold(rows, 0.9)
    assert 20 < len(set(got.values())) < 250


def test_a_user_of_many_memories(spark):
    rnd = np.random.default_rng(2)
    v = vectors(rnd, 5000, 60, 0.08) + vectors(rnd, 400, 400, 0.0) + [vectors(rnd, 1, 1, 0.0)[0]] * 600
    rows = [(1, k, "fact", x, float(rnd.random())) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "user long, id long, kind string, vector array<float>, salience double").repartition(4)
    got = {(r.user, r.id): r.into for r in C.merged_into(df, 0.9, 500).collect()}
    want = fold(rows, 0.9)
    assert sum(got[k] == want[k] for k in want) >= 0.999 * len(want)
    bits, tables = C.tables_for(5000, 0.9)
    assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= C.FOUND
    b = C._bucketed(df.select("user", "kind", "id", "salience", "vector"), bits, tables).groupBy("table", "bucket").count().agg({"count": "max"}).first()[0]
    assert b < len(rows) / 2


def test_a_bucket_tells_a_row_a_member():
    import pandas as pd

    n = 3000
    pdf = pd.DataFrame({"user": 1, "kind": "f", "id": range(n), "salience": [1 - k / n for k in range(n)], "vector": [[1.0, k / n / 10] for k in range(n)], "kept": [k == 5 for k in range(n)]})
    out = C._near_before(pdf, 0.9)
    assert len(out) == n and not out["waits"][0] and out["waits"][1:].all()
    assert out["into"][:6].isna().all() and (out["into"][6:] == 5).all()


def memories():
    rnd = np.random.default_rng(4)
    v = vectors(rnd, 120, 12, 0.15)
    r = random.Random(4)
    return [(k % 6, k, "fact" if k % 4 else "task", f"text {k}", v[k], r.random(), r.randrange(5), NOW - 50 * DAY, NOW - r.randrange(60) * DAY, r.choice([None, None, NOW + DAY, NOW - DAY, NOW]), None) for k in range(120)]


PROFILES = [(0, True), (1, True), (2, False), (3, True), (5, True)]


def aged(s, last):
    return min(1.0, max(0.0, s - 0.01 * max(0.0, (NOW - last) / DAY)))


def test_a_pass(spark):
    rows = memories()
    out = C.consolidate(spark.createDataFrame(rows, C.MEMORY), spark.createDataFrame(PROFILES, "user long, memory_consent boolean"), NOW, 0.9, 7)
    after = {(r.user, r.id): r for r in out["memories"].collect()}
    report = {r.user: r for r in out["report"].collect()}
    assert {u: r.skipped_reason for u, r in report.items()} == {0: None, 1: None, 2: "no_consent", 3: None, 4: "consent_unknown", 5: None}
    for user in range(6):
        own = [r for r in rows if r[0] == user]
        if report[user].skipped_reason:
            assert {i for u, i in after if u == user} == {r[1] for r in own}
            continue
        live = [r for r in own if r[9] is None or r[9] > NOW]
        into = fold([(r[0], r[1], r[2], r[4], aged(r[5], r[8])) for r in live], 0.9)
        kept = {}
        for r in sorted(live, key=lambda r: (-aged(r[5], r[8]), r[1])):
            k = into[user, r[1]]
            if k == r[1]:
                kept[k] = [r[5], r[6], None, r[8]]
            else:
                kept[k][0], kept[k][1], kept[k][2] = max(kept[k][0], r[5]), kept[k][1] + r[6], r[1]
        order = sorted(kept, key=lambda k: (-aged(kept[k][0], kept[k][3]), k))
        x = report[user]
        assert (x.scanned, x.expired, x.merged, x.pruned) == (len(live), len(own) - len(live), len(live) - len(kept), max(0, len(kept) - 7))
        assert x.decayed == sum(abs(aged(s, last) - s) >= C.EPSILON for s, _, _, last in kept.values())
        mine = {i: after[user, i] for u, i in after if u == user}
        assert set(mine) == set(order[:7])
        for i, m in mine.items():
            s, hits, gone, last = kept[i]
            assert abs(m.salience - aged(s, last)) < 1e-12 and (m.hits, m.supersedes) == (hits, gone)
    assert {r.user for r in out["profiles"].collect()} == {u for u, r in report.items() if r.profile_refreshed}
    assert sum(r.merged for r in report.values()) > 5


def test_empty(spark):
    none = spark.createDataFrame([], C.MEMORY)
    out = C.consolidate(none, spark.createDataFrame(PROFILES, "user long, memory_consent boolean"), NOW)
    assert all(x.collect() == [] for x in out.values())


def test_write_back(spark):
    held = [(1, 1, "fact", "Likes tea", [1.0, 0.0], 0.5, 3, 0, NOW, None, None), (1, 2, "fact", "Old", [0.0, 1.0], 0.5, 0, 0, NOW, NOW - 1, None), (1, 3, "fact", "Faded", [0.0, -1.0], 0.01, 0, 0, NOW, None, None), (9, 4, "fact", "Other user", [1.0, 0.0], 0.1, 0, 0, NOW, None, None)]
    new = [(1, 11, "fact", " likes TEA ", [1.0, 0.01], 0.4), (1, 12, "fact", "Likes coffee, me@x.org", [1.0, 0.05], 2.0), (1, 13, "task", "Own", [0.0, 1.0], -1.0), (1, 14, "fact", "  ", [1.0, 0.0], 1.0), (2, 15, "fact", "No consent", [1.0, 0.0], 1.0), (7, 16, "fact", "Unknown", [1.0, 0.0], 1.0)]
    out = C.write_back(spark.createDataFrame(new, "user long, id long, kind string, text string, vector array<float>, salience double"), spark.createDataFrame(held, C.MEMORY), spark.createDataFrame(PROFILES, "user long, memory_consent boolean"), NOW, 0.9, 3)
    assert {(r.user, r.id, r.supersedes) for r in out["stored"].collect()} == {(1, 12, 1), (1, 13, None)}
    after = {r.id: r for r in out["memories"].collect()}
    assert set(after) == {2, 3, 4, 12}  # three of user 1: the least salient, the new 13, has no room
    assert after[12].salience == 1.0 and after[12].expires == NOW + 365 * DAY and "me@x.org" not in after[12].text


@pytest.mark.parametrize("name", ["mem_consolidate", "mem_profile", "mem_write"])
def test_queries(spark, sf, name):
    from loomstone.plans import registry

    rows = registry.queries()[name](spark, sf).collect()
    assert rows and len({r[0:2] for r in rows}) == len(rows)
    if name == "mem_consolidate":
        assert {r.skipped_reason for r in rows} == {None, "no_consent", "consent_unknown"} and sum(r.merged for r in rows) > 0
