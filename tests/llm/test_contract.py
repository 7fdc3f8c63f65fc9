"""Every query of the subpackage on the smallest tables: columns, types and, where nothing else holds them, values."""

import hashlib
import zlib

import numpy as np
import pytest

from loomstone.llm import edit_fingerprint, queries, tiff
from loomstone.llm.common import documents

COLUMNS = {
    "op1_edit_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_tiff_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op5_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_bpe_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}
#: Those that report on the whole table have no row for each document.
REPORTS = ("op11_filter_audit", "op12_lexical_search")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}


@pytest.fixture(scope="module")
def got(spark, sf):
    found = {}

    def rows(name):
        if name not in found:
            df = queries.queries()[name](spark, sf)
            found[name] = (dict(df.dtypes), df.collect())
        return found[name]

    return rows


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(name, got, texts):
    types, rows = got(name)
    want = dict(x.split() for x in COLUMNS[name].split(", "))
    assert {c: types[c] for c in want} == want
    if name not in REPORTS:
        assert {r.doc_id for r in rows} == set(texts)
    assert name.startswith("op7") or name in REPORTS or len(rows) == len(texts)
    assert all(r[c] is not None for r in rows for c in want)


def test_held_out(got):
    for name, base, fold in (("op2_language_id", 4, 2), ("op6_lm_scoring", 5, 1)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % base == fold) for r in got(name)[1])


def test_fingerprints(got, texts):
    rows = sorted(got("op1_edit_fingerprints")[1], key=lambda r: r.doc_id)
    for k, r in enumerate(rows):
        text, after = texts[r.doc_id], texts[rows[(k + 1) % len(rows)].doc_id]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == edit_fingerprint.text_of(edit_fingerprint.fingerprints([text])[0])
        equal = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 16) * 16 / 15)
        assert abs(r.near_edited - equal(r.fingerprint, r.edited_fingerprint)) < 1e-9 and abs(r.near_next - equal(r.fingerprint, rows[(k + 1) % len(rows)].fingerprint)) < 1e-9


def test_media(got, texts):
    for r in got("op3_tiff_media")[1]:
        payload = texts[r.doc_id].encode()
        payload += b"\0" * (max(64, -(-len(payload) // 64) * 64) - len(payload))
        media = tiff.write_gray(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        samples = list(payload)
        mean = sum(samples) / len(samples)
        edge = np.linspace(0, len(samples), 65).astype(int).tolist()
        bits = "".join("1" if sum(samples[i:j]) / max(1, j - i) > mean else "0" for i, j in zip(edge, edge[1:], strict=False))
        levels = [sum(x // 16 == k for x in samples) * 15 // len(samples) for k in range(16)]
        assert r.feature == f"{int(bits, 2):016x}-" + "".join(f"{x:x}" for x in levels)


def test_languages_are_learned(got, spark, sf):
    labels = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    held = [r for r in got("op2_language_id")[1] if r.held_out and labels[r.doc_id] and any(map(str.isalpha, labels[r.doc_id]))]
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.9 * len(held) > 10


def test_equal_texts_are_equal(got, texts):
    for name in ("op1_edit_fingerprints", "op2_language_id", "op3_tiff_media", "op10_bpe_codec"):
        seen = {}
        for r in got(name)[1]:
            own = {k: v for k, v in r.asDict().items() if k in ("fingerprint", "lang_pred", "score", "media_sha256", "feature", "ids_sha256")}
            assert seen.setdefault(texts[r.doc_id], own) == own
