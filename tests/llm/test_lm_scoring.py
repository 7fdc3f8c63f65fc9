import random

import numpy as np

from loomstone.llm import lm_scoring


def vocabulary(k, rare=7):
    counts = np.sort(np.random.default_rng(3).zipf(1.3, size=k).clip(1, 10**6))[::-1].astype(np.int64)
    return lm_scoring.Vocabulary(np.arange(k, dtype=np.int64) - (1 << 62), counts, int(counts.sum()) + rare, k + 4)


def test_words_of_every_rank_are_modelled():
    """Rare words have leaves of their own, and each is a context of its own."""
    k = 5000
    v = vocabulary(k)
    w = lm_scoring.Weights(v)
    rng = np.random.default_rng(0)
    w.c[:], w.m[:] = rng.normal(size=w.c.shape), rng.normal(size=w.m.shape)

    def after(context, words):
        codes = np.array([x for word in words for x in (3, context, word)], dtype=np.uint64)
        return w.log_probs(*v.features(codes, np.full(len(words), 3)))[2::3]

    for context in (4000, 4001, (1 << 63) + 5):
        assert abs(np.exp(after(context, range(k + 1))).sum() - 1) < 1e-4
    one, two, unknown, other = (after(c, [2500, 4900]) for c in (4000, 4001, (1 << 63) + 5, (1 << 63) + 6))
    assert np.all(one != two) and np.all(unknown != other)
    assert abs((one[0] - one[1]) - (two[0] - two[1])) > 1e-6


def test_untrained_is_unigram():
    v = vocabulary(3000)
    codes = np.arange(3001, dtype=np.uint64)
    got = lm_scoring.Weights(v).log_probs(*v.features(codes, np.array([3001])))
    assert np.allclose(got, np.log(np.append(v.counts + 0.5, v.rare_total) / (v.tokens + 0.5 * (v.kinds + 1))), atol=1e-4)


def test_tables_grow():
    small, large = (lm_scoring.Vocabulary(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, kinds) for kinds in (10, 1 << 24))
    assert large.root_rows > small.root_rows and large.node_rows > small.node_rows


def test_rare_pairs_are_learned():
    """Words past rank 2048 that follow each other are likelier than the same words apart."""
    v = vocabulary(4000)
    w = lm_scoring.Weights(v)
    pairs = np.array([[2100 + 2 * k, 2101 + 2 * k] for k in range(900)], dtype=np.uint64)
    held = v.features(np.tile(pairs, (10, 1)).ravel(), np.full(9000, 2))
    w.train([held])
    seen = w.log_probs(*v.features(pairs.ravel(), np.full(900, 2)))[1::2]
    mixed = np.stack([pairs[:, 0], np.roll(pairs[:, 1], 1)], axis=1)
    apart = w.log_probs(*v.features(mixed.ravel(), np.full(900, 2)))[1::2]
    assert seen.mean() > apart.mean() + 1


def test_scores_by_hand():
    """The score of a text is the product of softmaxes down the tree, word by word."""
    v = vocabulary(300)
    w = lm_scoring.Weights(v)
    rng = np.random.default_rng(2)
    w.c[:], w.m[:] = rng.normal(size=w.c.shape), rng.normal(size=w.m.shape)
    codes = np.append(rng.integers(0, 301, 40), [(1 << 63) + 9, 5]).astype(np.uint64)
    leaf, f = v.features(codes, np.array([20, 22]))
    got = w.log_probs(leaf, f)
    for k in range(len(codes)):
        rows = [(w.c[[int(x) % v.root_rows for x in f[k]]].sum(axis=0) + v.root_bias, v.top[leaf[k]])]
        for s in range(v.path_start[leaf[k]], v.path_start[leaf[k]] + v.depth[leaf[k]]):
            node = v.path_node[s]
            at = w._node_rows(f[k : k + 1], np.array([node]))[0]
            rows.append((w.m[at].sum(axis=0) + v.node_bias[node], v.path_branch[s]))
        want = sum(z[b] - np.log(np.exp(z.astype(np.float64)).sum()) for z, b in rows)
        assert abs(got[k] - want) < 1e-3


def test_gain_and_layouts(spark):
    """Held-out texts are likelier under the model than under unigrams, and other files give the same scores."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where(~lm_scoring.held_out()).select("text")
    one = {(r.doc_id, r.th): r for r in lm_scoring.lm_scores(docs, train).collect()}
    other = {(r.doc_id, r.th): r for r in lm_scoring.lm_scores(docs.repartition(5), train.repartition(3)).collect()}
    held = {r.doc_id for r in docs.where(lm_scoring.held_out()).select("doc_id").collect()}
    assert len(held) > 100 and sum(r.score for (d, _), r in one.items() if d in held) > sum(r.base_score for (d, _), r in one.items() if d in held)
    assert max(abs(r.score - other[k].score) for k, r in one.items()) < 1e-6 * max(abs(r.score) for r in one.values())


def test_words_as_by_split():
    rnd = random.Random(1)
    texts = [b"", b" ", b"A b", "é Ü \x0b x\x0cy\r\tÀ".encode()] + [bytes(rnd.choice(b"abAB \n\t\xc3\xa9") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    codes, n = lm_scoring.Codes().of(texts)
    words = [w for t in texts for w in [*t.lower().split(), None]]
    assert n.tolist() == [len(t.split()) + 1 for t in texts]
    pairs = set(zip(words, codes.tolist(), strict=True))
    assert len(pairs) == len(set(words)) == len(set(codes.tolist()))
    known = np.unique(codes)[::2]
    numbers = {int(h): k for k, h in enumerate(known.tolist())}
    assert lm_scoring.Codes(known).of(texts)[0].tolist() == [numbers.get(c, c) for c in codes.tolist()]
