"""Operators on a small table of hard cases, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loomstone.llm import bpe, edit_fingerprint, families, jaccard_join, language_id, line_dedup, lm_scoring, packing, substring_dedup, suffix_dedup, tiff
from loomstone.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, piece string, key long"


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    texts = ["\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 12))) for _ in range(30)]
    near = texts[0].split(" ")
    near[len(near) // 2] = "changed"
    passage = " ".join(rnd.choice(words) for _ in range(90))
    texts += [texts[1], " ".join(near), None, "", "  \t\n\x0b", "x", "ab " * 400, "Hello WORLD 123 ½ don't <|endoftext|> \x1c ΑΣ", "日本語 テキスト", "a" * 3000, passage, "one " + passage + " two", texts[3] + "\n" + passage + "\nEnd"]
    texts += ["  Shared Line \t\nown " + str(k) for k in range(12)]
    return [(7 * k, t, "en" if k % 3 else None, "s", 0, "clash", "clash", 1) for k, t in enumerate(texts)] + [(14, texts[2], "en", "s", 0, "", "", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def data(text):
    return (text or "").encode()


def test_line_dedup(docs):
    want, count = {}, Counter()
    for _, t, *_ in corpus():
        count.update({k for x in data(t).split(b"\n") if (k := x.strip(b" \t\n\x0b\x0c\r").lower())})
    for d, t, *_ in corpus():
        lines = data(t).split(b"\n")
        kept = [x for x in lines if count[x.strip(b" \t\n\x0b\x0c\r").lower()] < 10]
        want[d] = (len(lines), len(lines) - len(kept), b"\n".join(kept).decode())
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(corpus())
    assert all((r.n_lines, r.n_dropped, r.kept) == want[r.doc_id] for r in got)
    assert max(r.n_dropped for r in got) == 1


def shingles(t):
    w = data(t).lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_jaccard_join(docs):
    rows = corpus()
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    want = {rows[k][0]: (len(sets[k]), min(rows[j][0] for j in range(len(rows)) if root(j) == root(k))) for k in range(len(rows))}
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)

@pytest.mark.parametrize("texts", [["one two three four"], [None, "a b c d e f"], [f"{k} w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f" for k in range(300)], ["a b c d e f g", "h i j k l m n", "a b c d e f g"]])
def test_jaccard_without_links(spark, texts):
    """Tables in which no bucket, or only some, have a shared token; a null id beside others."""
    df = spark.createDataFrame([(None if k == 0 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = jaccard_join.jaccard_join(df).collect()
    same = {t: [k or None for k, x in enumerate(texts) if x == t] for t in texts}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in got) == sorted((k == 0, k, min(x for x in same[t] if x) if t and any(same[t]) else 0) for k, t in enumerate(texts))


def near_copies(n, seed=2, size=120):
    base, rnd, rows = [f"w{k}" for k in range(size)], random.Random(seed), []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"x{k}{rnd.random()}"
        rows.append(" ".join(w))
    return rows


def classes_of(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_jaccard_large_families(monkeypatch, spark):
    """Families dealt out in blocks, with what lies outside the largest class in a second round, against brute force."""
    chain = [f"c{k}" for k in range(60)]
    texts = near_copies(70)
    for k in range(25):  # a chain whose ends are unlike, hanging on the copies by prefix tokens only
        chain = chain[1:] + [f"d{k}"]
        texts.append(" ".join([f"w{k}" for k in range(12)] + chain))
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(families, "BLOCK", 6)
    monkeypatch.setattr(families, "PIVOTS", 2)
    want = classes_of(texts)
    assert [r.component_id for r in sorted(jaccard_join.jaccard_join(df).collect())] == want
    assert len(set(want)) > 3


def test_jaccard_candidates_pass_every_order():
    sets = [np.unique(x) for x in jaccard_join.shingle_sets([t.encode() for t in near_copies(40)], jaccard_join.WordHashes())]
    orders = jaccard_join.Orders(np.random.default_rng(1).integers(0, 99, 1 << jaccard_join.CELL_BITS, dtype=np.uint8))
    family = jaccard_join.Family(sets, orders)
    for k, s in enumerate(sets):
        want = [j for j, t in enumerate(sets) if all(np.intersect1d(orders.prefix(s, o), orders.prefix(t, o)).size for o in jaccard_join.ORDERS)]
        assert family.candidates(k).tolist() == want
        both = [len(np.intersect1d(s, t)) for t in sets]
        assert family.linked(k).tolist() == [j for j in range(40) if 100 * both[j] >= 80 * (len(s) + len(sets[j]) - both[j])]


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    parent = {k: k for e in edges for k in e}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for a, b in edges if a != b for k in (a, b)}


def test_substring_dedup(docs):
    rows = sorted(corpus(), key=lambda r: r[0])
    first = {}
    for d, t, *_ in rows:
        w = data(t).split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        w = data(texts[r.doc_id]).split()
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r.doc_id for j in range(k, k + 50)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert sum(r.n_removed for r in got) > 100


def test_reference_spans(docs, spark):
    ref = corpus()[40][1]
    got = by_id(substring_dedup.remove_reference_spans(docs, [ref]))
    assert got[40 * 7].n_removed == 90 and got[41 * 7].kept == "one two"
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs, ["a " * 500_000])


def test_suffix_dedup(docs):
    rows = corpus()
    count = Counter()
    for _, t, *_ in rows:
        count.update(data(t)[k : k + 400] for k in range(len(data(t)) - 399))
    texts = {d: t for d, t, *_ in rows}
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        b = data(texts[r.doc_id])
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = 1
        gone[-1] = 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), int((np.diff(np.append(0, gone)) == 1).sum()))
        assert r.kept == bytes(x for x, y in zip(b, gone, strict=False) if not y)


def test_suffix_order(monkeypatch):
    rnd = np.random.default_rng(1)
    for n, kinds in ((70, 2), (500, 3), (900, 200), (400, 1)):
        t = np.append(rnd.integers(1, kinds + 1, n), 0).astype(np.int16)
        t[n // 2 : n] = t[: n - n // 2]
        for most in (1 << 20, 64):  # the second puts the queue into its file
            monkeypatch.setattr(suffix_dedup.Queue.__init__, "__defaults__", (most,))
            assert suffix_dedup.suffix_order(t, kinds + 1).tolist() == sorted(range(n + 1), key=lambda i: bytes(t[i:].astype(np.uint8)))


def test_bpe_matches_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {d: t or "" for d, t, *_ in corpus()}
    encoded = bpe.bpe_encode(docs).cache()
    for r in encoded.collect():
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids
    for r in bpe.bpe_decode(encoded).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    for r in bpe.bpe_round_trip(docs).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_bpe_random_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.Encoder(path)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcThe '’.,!éßΣς İ\n\t12٣ ́\U0001f600xyz<|>") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    ids, ends = own.encode(texts)
    begin = 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == lib.encode(t, add_special_tokens=False).ids, t
        begin = end


def test_packing(docs):
    got = packing.pack_documents(docs, capacity=64).collect()
    enc = bpe.encoder(bpe.TOKENIZER)
    want = Counter()
    for d, t, *_ in corpus():
        ids = [*enc.encode([t or ""])[0].tolist(), 1]
        for p, at in enumerate(range(0, len(ids), 64)):
            cut = ids[at : at + 64]
            want[d, p, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == plain_best_fit([r.length for r in got], 64)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_plan():
    rnd = random.Random(8)
    for _ in range(100):
        lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 150))]
        assert packing.best_fit_decreasing(Counter(lengths), 50)[1] == plain_best_fit(lengths, 50)


def test_tiff_round_trips():
    rnd = random.Random(3)
    for n in (64, 640, 6400):
        payload = bytes(rnd.choice(b"aab c\xff") for _ in range(n))
        for compression in tiff.ENCODERS:
            for predictor in (1, 2):
                media = tiff.write_gray(payload, compression=compression, predictor=predictor, strip_rows=7, page_rows=40)
                pages = list(tiff.pages(media))
                assert b"".join(p["pixels"] for p in pages) == payload
                assert [p["page"] for p in pages] == list(range(len(pages)))


def tiled(samples, tile=16, compression=tiff.DEFLATE):
    """A big-endian file of 16-bit samples in tiles, horizontally differenced."""
    import struct

    h, w = samples.shape
    out, offsets, counts = bytearray(b"MM\0\x2a\0\0\0\0"), [], []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            cell = np.zeros((tile, tile), dtype=np.uint16)
            part = samples[y : y + tile, x : x + tile]
            cell[: part.shape[0], : part.shape[1]] = part
            cell[:, 1:] -= cell[:, :-1].copy()
            raw = tiff.ENCODERS[compression](cell.astype(">u2").tobytes())
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
    far = {}
    for tag, v in ((324, offsets), (325, counts)):
        far[tag] = len(out)
        out += struct.pack(f">{len(v)}I", *v)
    struct.pack_into(">I", out, 4, len(out))
    short = lambda v: v << 16
    fields = [(256, 3, 1, short(w)), (257, 3, 1, short(h)), (258, 3, 1, short(16)), (259, 3, 1, short(compression)), (277, 3, 1, short(1)), (317, 3, 1, short(2)), (322, 3, 1, short(tile)), (323, 3, 1, short(tile)), (324, 4, len(offsets), far[324]), (325, 4, len(counts), far[325])]
    out += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0\0\0\0"
    return bytes(out)


def test_tiff_tiles_and_errors(spark):
    samples = np.random.default_rng(0).integers(0, 65536, (37, 53), dtype=np.uint16)
    good = tiled(samples)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(good[:60]))], "i long, m binary")
    got = {r.file_id: r for r in tiff.tiff_pages(df, "i", "m").collect()}
    assert np.array_equal(np.frombuffer(got[1].pixels, dtype=">u2").reshape(37, 53), samples)
    assert 2 not in got and got[3].page == -1 and got[4].page == -1 and got[4].error


def test_media_digest(docs):
    texts = {d: data(t) for d, t, *_ in corpus()}
    for r in tiff.media_digest(tiff.to_tiff(docs)).collect():
        payload = texts[r.doc_id].ljust(max(64, -(-len(texts[r.doc_id]) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_edit_fingerprints(docs):
    rows = sorted(corpus(), key=lambda r: r[0])
    got = edit_fingerprint.edit_fingerprints(docs).collect()
    assert len(got) == len(rows)
    # Rows of one id and text have a next document each: the other copy, or what follows.
    texts = [r[1] or "" for r in rows]
    want = Counter()
    for k, r in enumerate(rows):
        after = texts[(k + 1) % len(rows)]
        new = edit_fingerprint.edited(texts[k], after)
        a, b, c = edit_fingerprint.fingerprints([texts[k], new, after])
        want[r[0], len(texts[k]), hashlib.sha256(new.encode()).hexdigest(), edit_fingerprint.text_of(a), edit_fingerprint.text_of(b), round(edit_fingerprint.likeness(a, b), 9), round(edit_fingerprint.likeness(a, c), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_language_id(spark):
    rnd = random.Random(6)
    own = {"aa": ["tion", "ing", "the", "and", "er"], "bb": ["ung", "lich", "ein", "sch", "der"], "cc": ["при", "вет", "мир", "на", "дом"]}

    def text(lang, n=40):
        return " ".join("".join(rnd.choice(own[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))

    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out()))
    mixed = text("aa", 30) + " 123 " + text("bb", 30)
    test = spark.createDataFrame([*rows, (900, mixed, None), (901, None, None), (902, "12 ... \n", None), (903, "日本", None)], "doc_id long, text string, lang string")
    got = by_id(language_id.identify(test, model))
    assert all(got[d].lang_pred == lang for d, _, lang in rows)
    assert [s.lang for s in got[900].spans] == ["aa", "bb"] and abs(got[900].spans[0].n_words - 30) <= 2
    assert (got[901].lang_pred, got[901].score) == ("und", 0.0) and got[902].lang_pred == "und" and got[903].lang_pred in own
    none = language_id.fit(df.where("false"))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_lm_scores(docs):
    import math

    train = docs.where(~lm_scoring.held_out())
    got = by_id(lm_scoring.lm_scores(docs, train.select("text")))
    tokens = {d: [*data(t).lower().split(), None] for d, t, *_ in corpus()}
    count = Counter()
    for d, t, *_ in corpus():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update([*data(t).lower().split(), None])
    n, kinds = sum(count.values()), len(count)
    for d, own in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in own)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert abs(got[d].base_score - base) < 1e-6 * max(1, abs(base))
        assert got[d].score < 0


def test_lm_is_normalised():
    """Over all words, and the unseen as one, the probabilities after any word sum to 1."""
    counts = np.array([50, 40, 30, 20, 10, 5, 3, 2, 1, 1], dtype=np.int64)
    hashes = np.arange(10, dtype=np.int64) - (1 << 62)
    v = lm_scoring.Vocabulary(hashes, counts, int(counts.sum()) + 7, 14)
    w = lm_scoring.Weights(v)
    rng = np.random.default_rng(0)
    w.c[:] = rng.normal(size=w.c.shape)
    w.m[:] = rng.normal(size=w.m.shape)
    total = 0.0
    for word in range(11):
        codes = np.array([3, 5, word], dtype=np.uint64)
        own, f = v.features(codes, np.array([3]))
        total += float(np.exp(w.log_probs(own, f)[2]))
    assert abs(total - 1) < 1e-5


OPERATORS = {
    "lines": line_dedup.line_dedup,
    "jaccard": jaccard_join.jaccard_join,
    "substrings": substring_dedup.substring_dedup,
    "suffixes": suffix_dedup.suffix_dedup,
    "bpe": bpe.bpe_round_trip,
    "packing": packing.pack_documents,
    "media": lambda d: tiff.media_digest(tiff.to_tiff(d)),
    "fingerprints": edit_fingerprint.edit_fingerprints,
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "scores": lambda d: lm_scoring.lm_scores(d, d.select("text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(name, spark):
    df = spark.createDataFrame([(None, "a b c d e f", None), (None, None, None), (1, "a b c d e f", "en")], "doc_id long, text string, lang string")
    got = OPERATORS[name](df).collect()
    assert len(got) == 3 and sum(r.doc_id is None for r in got) == 2


def test_tiff_hostile_and_half_broken(spark):
    import struct

    def one_page(width, height, raw, compression=1, bits=8, predictor=1, extra=()):
        fields = sorted([(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (259, 3, 1, compression), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, height), (279, 4, 1, len(raw)), (317, 3, 1, predictor), *extra])
        return b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + b"\0\0\0\0"

    payload = bytes(range(256)) * 64
    whole = bytearray(tiff.write_gray(payload, page_rows=64))
    n_pages = len(list(tiff.pages(bytes(whole))))
    at = struct.unpack_from("<I", whole, 4)[0]
    for _ in range(2):  # the third directory gets a compression that does not exist
        at = struct.unpack_from("<I", whole, at + 2 + 12 * struct.unpack_from("<H", whole, at)[0])[0]
    struct.pack_into("<I", whole, at + 2 + 12 * 3 + 8, 99)
    files = [one_page(1 << 20, 1 << 20, b"x" * 20, 8), one_page(1 << 31, 4, b"x"), one_page(8, 8, zlib.compress(bytes(10**7)), 8), one_page(8, 8, b"abc"), one_page(8, 8, bytes(range(16)), bits=2, predictor=2), one_page(8, 1, b"\x01\x80" * 4, extra=[(266, 3, 1, 2)]), bytes(whole)]
    df = spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(files)] + [(None, bytearray(files[5]))], "i long, m binary").selectExpr("i", "m", "'x' AS file_id", "1 AS media")
    got = tiff.tiff_pages(df, "i", "m").collect()
    pages = {k: [(r.page, r.error is not None) for r in got if r.file_id == k] for k in [*range(len(files)), None]}
    assert [pages[k] for k in (0, 1, 3, 4)] == [[(-1, True)]] * 4 and pages[2] == [(0, False)]
    assert pages[5] == pages[None] == [(0, False)] and next(r.pixels for r in got if r.file_id == 5) == b"\x80\x01" * 4
    assert n_pages == 4 and pages[6] == [(0, False), (1, False), (-1, True)]


def test_tiff_planes_float_and_big():
    """Separate planes, the floating-point predictor and 64-bit offsets, each undone by hand."""
    import struct

    def write(fields, strips, big=False):
        word, entry = ("Q", 16) if big else ("I", 4)
        out = bytearray(b"II+\0\x08\0\0\0" + bytes(8) if big else b"II*\0" + bytes(4))
        offsets = []
        for x in strips:
            offsets.append(len(out))
            out += x
        kind, far = (16 if big else 4), {}
        for tag, v in ((273, offsets), (279, [len(x) for x in strips])):
            far[tag] = v[0] if len(v) == 1 else len(out)
            if len(v) > 1:
                out += struct.pack(f"<{len(v)}{word}", *v)
        struct.pack_into("<" + word, out, 8 if big else 4, len(out))
        fields = sorted([*fields, (273, kind, len(strips), far[273]), (279, kind, len(strips), far[279])])
        out += struct.pack("<Q" if big else "<H", len(fields)) + b"".join(struct.pack("<HH" + 2 * word, *f) for f in fields) + bytes(entry)
        return bytes(out)

    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    base = [(256, 4, 1, 7), (257, 4, 1, 5), (278, 4, 1, 5)]
    planar = write([*base, (258, 3, 1, 8), (259, 3, 1, 1), (277, 3, 1, 3), (284, 3, 1, 2)], [rgb[:, :, k].tobytes() for k in range(3)])
    assert next(tiff.pages(planar))["pixels"] == rgb.tobytes()
    real = rng.normal(size=(5, 7)).astype("<f4")
    rows = b""
    for row in real:
        planes = np.frombuffer(row.astype(">f4").tobytes(), dtype=np.uint8).reshape(7, 4).T.ravel().astype(int)
        rows += bytes((np.diff(planes, prepend=0) % 256).tolist())
    for big in (False, True):
        got = next(tiff.pages(write([*base, (258, 3, 1, 32), (259, 3, 1, 8), (277, 3, 1, 1), (317, 3, 1, 3)], [zlib.compress(rows)], big)))
        assert got["pixels"] == real.tobytes() and got["bits"] == 32


def test_two_hundred_languages(spark):
    rnd = random.Random(11)
    own = {f"l{k:03d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(200)}
    rows = [(k, " ".join(rnd.choice(own[lang]) for _ in range(30)), lang) for k, lang in enumerate([*own] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.identify(df, language_id.fit(df)))
    assert all(got[d].lang_pred == lang for d, _, lang in rows)


def test_viterbi_matches_brute_force():
    import itertools

    rng = np.random.default_rng(8)
    for n, langs in ((1, 3), (4, 2), (6, 3)):
        known = rng.normal(scale=6, size=(20, langs)).astype(np.float32)
        slots = rng.integers(0, 20, n)
        best = max(itertools.product(range(langs), repeat=n), key=lambda p: sum(known[s, k] for s, k in zip(slots, p, strict=True)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(language_id.viterbi(known, slots, np.array([n]), 4.0).tolist()) == best


def test_suffix_prefixes_carried(monkeypatch):
    """Common prefixes from the queues are those of the strings, in memory and from the file, over two levels of recursion."""
    levels = []
    real = suffix_dedup._sorted_turns
    monkeypatch.setattr(suffix_dedup, "_sorted_turns", lambda *a: (levels.append(len(a[0])), real(*a))[1])
    rnd = np.random.default_rng(7)
    for n, kinds in ((70, 1), (300, 2), (900, 3), (1500, 60)):
        t = np.append(rnd.integers(1, kinds + 1, n), 0).astype(np.int16)
        t[n // 2 : n] = t[: n - n // 2]
        t[n // 4 : n // 4 + 20] = 1
        text = t.astype(np.uint8).tobytes()
        want = sorted(range(n + 1), key=lambda i: text[i:])
        common = [0] + [next((k for k in range(n + 1) if text[a + k : a + k + 1] != text[b + k : b + k + 1]), 0) for a, b in zip(want, want[1:], strict=False)]
        for most, base, cap in ((1 << 20, 1 << 24, n), (64, 16, n), (64, 16, 5)):
            monkeypatch.setattr(suffix_dedup.Queue.__init__, "__defaults__", (most,))
            monkeypatch.setattr(suffix_dedup, "BASE", base)
            levels.clear()
            order, prefixes = suffix_dedup.suffix_prefixes(t, kinds + 1, cap)
            assert order.tolist() == want
            assert [min(x, cap) for x in prefixes.tolist()] == [min(x, cap) for x in common]
            assert n < 900 or kinds > 3 or base > 16 or len(levels) >= 3
