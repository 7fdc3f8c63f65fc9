"""Texts longer than what a step holds at once: over a slice of an Arrow batch, and for media over a page."""

import hashlib
import random

import pytest

from loomstone.llm import bpe, edit_fingerprint, jaccard_join, language_id, line_dedup, packing, substring_dedup, tiff
from loomstone.llm.common import CHUNK_BYTES


def texts():
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdefgiklmnoprstuvwéü") for _ in range(rnd.randint(2, 9))) for _ in range(20_000)]
    lines = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(34_000)]
    one = "\n".join(lines)
    two = "\n".join([*lines[:20_000], "other words here", *(" ".join(rnd.choice(words) for _ in range(12)) for _ in range(9000))])
    return [(1, one, "aa"), (2, two, "aa"), (3, "a short text of its own", "bb"), (4, one, "aa")]


@pytest.fixture(scope="module")
def rows():
    made = texts()
    assert all(len(t.encode()) > CHUNK_BYTES for i, t, _ in made if i != 3)
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_lines(docs, rows):
    got = by_id(line_dedup.line_dedup(docs, min_docs=3))
    for i, t, _ in rows:
        lines = t.split("\n")
        n = 0 if i == 3 else 20_000  # what all three have
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), n) and got[i].kept == "\n".join(lines[n:])


def test_tokens(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = by_id(bpe.bpe_encode(docs))
    for i, text, _ in rows[1:3]:
        assert got[i].ids == t.encode(text, add_special_tokens=False).ids
    pieces = packing.pack_documents(docs).collect()
    for i, _, _ in rows:
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == i)
        total = len(got[i].ids) + 1
        assert own == [(s, min(4096, total - s)) for s in range(0, total, 4096)]


def test_shingles(docs, rows):
    got = by_id(jaccard_join.jaccard_join(docs))
    for i, t, _ in rows:
        w = t.lower().split()
        assert got[i].n_shingles == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 1]


def test_passages(docs, rows):
    got = by_id(substring_dedup.substring_dedup(docs))
    one, two = rows[0][1].split(), rows[1][1].split()
    assert got[1].n_removed == 0 and got[4].n_removed == len(one) and got[4].kept == ""
    assert got[2].n_removed == 20_000 * 12 and got[2].kept.split() == two[20_000 * 12 :]
    assert got[3].n_removed == 0


def test_languages_and_fingerprints(docs, rows):
    got = by_id(language_id.identify(docs, language_id.fit(docs, longest=1 << 30), spans=False))
    assert {got[i].lang_pred for i in (1, 2, 4)} == {"aa"} and got[1].score == got[4].score
    assert [edit_fingerprint.text_of(f) for f in edit_fingerprint.fingerprints([rows[0][1], rows[3][1]])][0] == edit_fingerprint.text_of(edit_fingerprint.fingerprints([rows[0][1]])[0])


def test_media_over_a_page(spark):
    text = "".join(f"{k:08d} é\n" for k in range(1_600_000))  # 17.6 MB of text, more than a page may have
    assert len(text.encode()) > 16 << 20
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = by_id(tiff.media_digest(tiff.to_tiff(df)))
    data = text.encode()
    payload = data + b"\0" * (-len(data) % 64)
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
    assert got[1].n_pages > 1 and got[2].n_pages == 1
