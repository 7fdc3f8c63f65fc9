"""Operators over runs, tools and prompts against brute force, and every query of theirs without SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone.operators import dedupe, fingerprints, parsing, pii, tools
from loomstone.plans import registry


def normal(x):
    return " ".join(re.findall(r"\w+", (x or "").lower()))


def simhash(x):
    w = normal(x).split()
    runs = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 4 else w
    h = [int(hashlib.md5(r.encode()).hexdigest()[:15], 16) for r in runs]
    return sum(1 << k for k in range(60) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else None


def texts():
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rnd.randrange(30)) for _ in range(60)) for _ in range(6)]
    out = []
    for x in base:
        w = x.split()
        for _ in range(5):
            w = list(w)
            w[rnd.randrange(60)] = "new" + str(rnd.randrange(99))
            out.append(" ".join(w))
    return [*base, *out, base[0], base[1].upper(), None, "", " ", "tiny", "Tiny!", out[3], "owned elsewhere", "owned elsewhere", "owned by itself"]


def test_ingest_like_one_by_one(spark):
    """The same reasons as deciding chunk by chunk."""
    rows = [(k, k, x) for k, x in enumerate(texts())]
    random.Random(1).shuffle(rows)
    owners = {hashlib.sha256(b"owned elsewhere").hexdigest(): 10_000, hashlib.sha256(b"owned by itself").hexdigest(): len(rows) - 1}
    seen, prints, want = set(), [], {}
    for k, document, x in sorted(rows, key=lambda r: r[0]):
        x = (x or "").strip()
        digest = hashlib.sha256(normal(x).encode()).hexdigest()
        s = simhash(x) if len(x) >= 64 else None
        if not x:
            want[k] = "empty"
        elif digest in seen:
            want[k] = "exact_duplicate_run"
        elif owners.get(digest, document) != document:
            want[k] = "exact_duplicate_corpus"
        elif s is not None and any((s ^ p).bit_count() <= 3 for p in prints):
            want[k] = "near_duplicate"
        else:
            want[k] = None
            seen.add(digest)
            if s is not None:
                prints.append(s)
    corpus = spark.createDataFrame(list(owners.items()), "digest string, owner long")
    got = {r.id: r.drop_reason for r in dedupe.ingest(spark.createDataFrame(rows, "id long, document long, text string"), corpus).collect()}
    assert got == want
    assert {"near_duplicate", "exact_duplicate_run", "exact_duplicate_corpus", "empty", None} == set(want.values())


def test_first_wins(spark):
    rnd = random.Random(3)
    pairs = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(70)}) + [(60 + k, 61 + k) for k in range(15)]
    want = {}
    for k in range(80):
        want[k] = not any(want[a] for a, b in pairs if b == k)
    got = {r.id: r.stays for r in dedupe.first_wins(spark.createDataFrame([(k,) for k in range(80)], "id long"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_short_texts_opt_out(spark):
    rows = [("q", 1, 1, "one two three four five"), ("q", 2, 2, "one two three four  five!"), ("q", 3, 3, "one two three four five six")]
    df = spark.createDataFrame(rows, "grp string, pos long, id long, text string")
    assert [r.reason for r in sorted(dedupe.retrieved(df).collect())] == [None, "exact_duplicate", None]


def test_near_pairs_whole(spark):
    rnd = random.Random(9)
    prints = [rnd.getrandbits(60) for _ in range(40)]
    for x in prints[:30]:
        for bits in range(1, 6):
            y = x
            for k in rnd.sample(range(60), bits):
                y ^= 1 << k
            prints.append(y)
    df = spark.createDataFrame(list(enumerate(prints)), "id long, simhash long")
    got = {(r.a, r.b) for r in fingerprints.near_pairs(df).collect()}
    assert got == {(a, b) for b in range(len(prints)) for a in range(b) if 0 < (prints[a] ^ prints[b]).bit_count() <= 3}
    assert len(got) > 80


def test_arguments(spark):
    schema = {"properties": {"a": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^x"}, "b": {"type": "number", "maximum": 5}, "c": {"type": "boolean"}, "d": {"enum": ["u", "v"]}}, "required": ["a"]}
    cases = {'{"a": "xy"}': [], '{"a": "x"}': ["a: shorter than minLength 2"], '{"a": "yyyyy", "b": 6}': ["a: does not match the required pattern", "a: longer than maxLength 4", "b: above maximum 5"], "{}": ["a: required"], '{"a": 3, "z": null}': ["a: expected string", "z: not declared"], '{"a": "xx", "c": 1, "d": "w"}': ["c: expected boolean", "d: not one of ['u', 'v']"], "[1]": ["<root>: expected object"], "junk": ["<root>: expected object"]}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: list(r.e) for r in df.select("j", tools.errors(F.col("j"), schema).alias("e")).collect()} == cases


def test_page_text_and_batches():
    out = parsing.parse_page_text("4.2 Retention\n\nSome long prose here,\nand more.\n\nShort Title\n\n- one\n2) two\n\nends with a colon:")
    assert [(b["kind"], b["text"], b["level"]) for b in out] == [("heading", "Retention", 2), ("paragraph", "Some long prose here, and more.", 0), ("heading", "Short Title", 2), ("list_item", "one", 0), ("list_item", "two", 0), ("paragraph", "ends with a colon:", 0)]
    body = [["word " * 20] for _ in range(30)]
    batches = parsing.table_batches(["h"], body, 120)
    assert [r for b in batches for r in b] == body and len(batches) > 3
    assert all(sum(parsing.tokens(" ".join(r)) for r in b) <= 120 for b in batches)
    one, two, three = ({"text": x, "section": [s], "tokens": parsing.tokens(x)} for x, s in (("word " * 100, "a"), ("end", "a"), ("end", "b")))
    assert len(parsing.merge_runt([one, two])) == 1 and len(parsing.merge_runt([one, three])) == 2 and len(parsing.merge_runt([one, one])) == 2


def test_second_look(spark):
    f = spark.createDataFrame([(1, "EMAIL", 0, 5, 0.9), (1, "EMAIL", 9, 12, 0.6), (2, "PAN", 0, 5, 0.9)], "id long, kind string, start int, end int, score double")
    no = spark.createDataFrame([(1, "EMAIL", 0, 5), (1, "EMAIL", 9, 12)], "id long, kind string, start int, end int")
    assert sorted((r.id, r.start) for r in pii.verified(f, no, 0.7).collect()) == [(1, 9), (2, 0)]


NAMES = "dedupe_ingest dedupe_retrieval pdf_text split_atomic table_batch merge_runt pii_find pii_overlap jwt_check pii_block_scan pii_verify conflict_numeric conflict_polarity".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, sf, name):
    rows = registry.queries()[name](spark, sf).collect()
    assert rows or name in ("jwt_check", "conflict_numeric")
