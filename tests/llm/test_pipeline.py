"""The stages of the pipeline on a small table of hard cases, each against brute force, and on the smallest tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from loomstone.llm.common import documents, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_h", "_d", "_th", "_k0", "row", "th", "d2", "key", "a.b"]
STAGES = dict(corpus_pipeline.STAGES)


def cases():
    rnd = random.Random(12)
    own = {"aa": ["tion", "ing", "the", "and"], "bb": ["ung", "lich", "ein", "sch"]}

    def prose(lang, n):
        return " ".join("".join(rnd.choice(own[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))

    texts = [prose("aa" if k % 2 else "bb", 60) for k in range(24)]
    passage = prose("aa", 70)
    texts += [texts[0], texts[0].upper(), texts[3] + " " + prose("bb", 2), prose("aa", 9) + " " + passage, passage + "\n" + prose("aa", 20)]
    texts += [None, "", " \n ", "12 34 !", prose("aa", 40) + " " + prose("bb", 40)]
    texts += ["common Line \n" + prose("bb", 8) + "\n\n" + str(k) for k in range(11)]
    rows = [(3 * k, t, "aa" if k % 5 else None, "s", 0) for k, t in enumerate(texts)]
    rows += [rows[1], (None, texts[2], "bb", "s", 0), (None, None, None, None, None), (3, "another text of the same id", "aa", "s", 0)]
    return [(*r, 1, "x", 2, "y", "z", 3, 4, "k", None) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    types = ["long", "string", "string", "string", "long", "int", "string", "long", "string", "string", "int", "int", "string", "string"]
    return spark.createDataFrame(cases(), ", ".join(f"`{c}` {t}" for c, t in zip(COLUMNS, types, strict=True))).repartition(2).cache()


def stage(spark, name, docs):
    out = STAGES[name](spark, docs, None)
    assert out.columns == COLUMNS
    got = [tuple(r) for r in out.collect()]
    assert all(r[5:] == (1, "x", 2, "y", "z", 3, 4, "k", None) for r in got)
    return Counter(r[:5] for r in got)


def test_language(spark, docs):
    got = stage(spark, "language", docs)
    rows = [r[:5] for r in cases()]
    gone = [r for r in rows if not any(c.isalpha() for c in r[1] or "")]
    assert len(gone) == 5
    names = {"aa", "bb"}
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in got.elements()) == sorted((r[0] is None, r[0] or 0, r[1]) for r in rows if r not in gone)
    assert all(r[2] in names for r in got)
    labels = {(r[0], r[1]): r[2] for r in rows}
    assert all(labels[r[0], r[1]] in (None, r[2]) for r in got)


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").lower()


def test_lines(spark, docs):
    rows = [r[:5] for r in cases()]
    count = Counter(k for r in rows for k in {key_of(x) for x in (r[1] or "").split("\n")} if k)
    want = Counter()
    for d, t, lang, source, _ in rows:
        kept = "\n".join(x for x in (t or "").split("\n") if count[key_of(x)] < 10)
        want[d, kept, lang, source, len(kept)] += 1
    assert stage(spark, "lines", docs) == want
    assert max(count.values()) == 11


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_similarity(spark, docs):
    rows = [r[:5] for r in cases()]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    got = stage(spark, "similarity", docs)
    assert max(got.values()) == 1
    stays, groups = {r[:2] for r in got}, {}
    for k, r in enumerate(rows):
        if sets[k]:
            groups.setdefault(root[k], set()).add(r[:2])
        else:
            assert r[:2] in stays
    for own in groups.values():
        ids = [d for d, _ in own if d is not None]
        (left,) = own & stays
        assert left[0] == (min(ids) if ids else None)
    assert len(groups) < len({r[:2] for k, r in enumerate(rows) if sets[k]})


def test_a_group_of_null_ids_keeps_one(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words[:-1], "another"])]
    rows = [(None, t, "en", "s", len(t)) for t in texts] + [(4, "x y", "en", "s", 3), (4, "x y", "en", "s", 3), (9, " ".join(reversed(words)), "en", "s", 1), (9, " ".join([*reversed(words[1:]), "z"]), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["similarity"](spark, df, "").collect()
    assert sorted((r.doc_id for r in got), key=repr) == [4, 9, None]


def test_substrings(spark, docs):
    rows = [r[:5] for r in cases()]
    first = {}
    last = 1 << 63
    for d, t, *_ in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, last), last - 1 if d is None else d)
    want = Counter()
    for d, t, lang, source, _ in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (last - 1 if d is None else d) for j in range(k, k + 50)}
        new = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        want[d, new, lang, source, None if new is None else len(new)] += 1
    assert stage(spark, "substrings", docs) == want


def test_packing(spark, docs):
    got = corpus_pipeline.into_sequences(spark, docs, None).collect()
    per = Counter((r.doc_id, r.piece) for r in got)
    assert set(d for d, _ in per) == {r[0] for r in cases()} and sum(r.length for r in got) > 1000
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("name", list(STAGES))
def test_empty(spark, docs, name):
    assert STAGES[name](spark, docs.where("false"), None).count() == 0


def test_whole(spark, sf):
    docs = documents(spark, sf)
    columns, before = docs.columns, docs.count()
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = staged(fn(spark, docs, sf), name)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    digest = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert packed.select("doc_id").distinct().count() == before
    assert digest(packed) == digest(corpus_pipeline.run(spark, sf))
