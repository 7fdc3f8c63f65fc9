import random

import numpy as np
import pytest

from loomstone.llm import edit_fingerprint as E
from loomstone.llm import families


def prints():
    """Groups of near fingerprints, each member some digits off another; all share the digits of one band."""
    rnd = random.Random(4)
    band = sorted(np.random.default_rng(77).choice(E.SAMPLES, E.BAND_DIGITS, replace=False).tolist())
    out = []
    for _ in range(6):
        group = [[rnd.choice("0123456789abcdef") for _ in range(E.SAMPLES)]]
        for _ in range(7):
            own = list(rnd.choice(group))
            for k in rnd.sample(range(E.SAMPLES), 40):
                own[k] = rnd.choice("0123456789abcdef")
            group.append(own)
        out += group
    for own in out:
        for k in band:
            own[k] = "7"
    return sorted({"".join(x) for x in out})


def brute(all_, like=E.LIKE):
    d = np.array([[ord(c) for c in p] for p in all_])
    root = list(range(len(all_)))
    for a in range(len(all_)):
        for b in range(a):
            if E.likeness(d[a], d[b]) >= like and any((d[a][x] == d[b][x]).all() for x in E.bands()):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


@pytest.mark.parametrize("block", [256, 5])
def test_classes_match_brute_force(spark, monkeypatch, block):
    """Whole buckets, and buckets dealt out in blocks."""
    monkeypatch.setattr(families, "BLOCK", block)
    monkeypatch.setattr(families, "PIVOTS", 2)
    all_ = prints()
    root = brute(all_)
    df = spark.createDataFrame([(k, p) for k, p in enumerate(all_ + all_[:3])] + [(None, all_[0]), (99, None)], "doc_id long, fingerprint string")
    rows = E.similar_classes(df).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(all_) + 5
    assert [got[k] for k in range(len(all_))] == root
    assert [got[len(all_) + k] for k in range(3)] == [got[k] for k in range(3)] and got[None] == got[0]
    assert len(set(root)) < len(all_)


def test_links_reach_past_the_least(spark):
    """A bucket whose least fingerprint is unlike the rest still joins the rest."""
    banded = {k for own in E.bands() for k in own}
    a = "f" * E.SAMPLES
    b = "".join("e" if k not in banded and k % 4 == 0 else "f" for k in range(E.SAMPLES))
    least = "".join("f" if k in banded else "0" for k in range(E.SAMPLES))
    df = spark.createDataFrame([(k, x) for k, x in enumerate((a, b, least))], "doc_id long, fingerprint string")
    assert {r.doc_id: r.class_id for r in E.similar_classes(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_walk_by_hand():
    """The shared walk and its samples, step by step, against the batched ones."""
    jump, steps = E.tables()
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdé ") for _ in range(n)) for n in (0, 1, 5, 300, 4000)] * 11
    for text, got in zip(texts, E.fingerprints(texts), strict=True):
        syms, at, reached = E.symbols(text), 0, []
        for s in syms:
            reached.append(at)
            while True:  # the walk stays on a character until its bit says to move on
                moves = jump[s, at % E.PERIOD] == 1
                at += 1
                if moves:
                    break
        want = []
        for k in range(E.SAMPLES if len(syms) else 0):
            step = max(x for x in steps[k].tolist() if x < at)
            j = max(i for i, x in enumerate(reached) if x <= step)
            want.append(int(E.mixed(np.uint64([syms[j]]) ^ E._SALT[k : k + 1], 3)[0] >> np.uint64(60)))
        assert got.tolist() == (want or [0] * E.SAMPLES)


def test_near_texts_meet(spark):
    """Texts with few edits are one class, others stay alone; many partitions, nulls and extra columns do no harm."""
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(900)) for _ in range(6)]
    near = [t[:600] + "xy" + t[601:] for t in texts[:4]]
    rows = [(k, t, "a", 1) for k, t in enumerate([*texts, *near, None, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, own int")
    got = {r.doc_id: r.class_id for r in E.similar_classes(E.edit_fingerprints(df)).collect()}
    assert got == {k: k for k in range(6)} | {6 + k: k for k in range(4)} | {10: 10, 11: 10}


def test_many_buckets(spark):
    cuts = list(range(0, 60_000, 10))
    df = spark.createDataFrame([(k,) for k in (None, -5, 0, 9, 10, 59_999, 1 << 60)], "doc_id long").select("doc_id", E._bucket(cuts).alias("b"))
    assert [r.b for r in df.collect()][1:] == [0, 1, 1, 2, 6000, 6000]
