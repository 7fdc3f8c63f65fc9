"""Operator 9 sorts the stretches that can hold a repeated window, and no others."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import runs, suffix_dedup

WINDOW, GRAM = suffix_dedup.WINDOW, suffix_dedup.GRAM


def noise(rnd: random.Random, n: int) -> bytes:
    return bytes(rnd.randrange(97, 123) for _ in range(n))


def stretches(texts: list[bytes]) -> dict[int, list[bytes]]:
    """Unlike stretches of the texts by key."""
    out: dict[int, dict[int, bytes]] = {}
    h = suffix_dedup._symbols()[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    own, start, n, key, g, _ = runs.runs(h, np.array([len(t) for t in texts]), WINDOW, GRAM)
    for o, s, m, k, e in zip(own.tolist(), start.tolist(), n.tolist(), key.view(np.int64).tolist(), g.view(np.int64).tolist(), strict=True):
        out.setdefault(k, {})[e] = texts[o][s : s + m + WINDOW - 1]
    return {k: list(v.values()) for k, v in out.items()}


def table(by_key: dict[int, list[bytes]]) -> pa.Table:
    flat = [(k, p) for k, parts in by_key.items() for p in parts]
    return pa.table({"key": pa.array([k for k, _ in flat], pa.int64()), "g": pa.array(range(len(flat)), pa.int64()), "bytes": pa.array([p for _, p in flat], pa.binary())})


def wanted(parts: list[bytes]) -> list[bool]:
    count = Counter(p[k : k + WINDOW] for p in parts for k in range(len(p) - WINDOW + 1))
    return [any(count[p[k : k + WINDOW]] > 1 for k in range(len(p) - WINDOW + 1)) for p in parts]


@pytest.mark.parametrize("seed", range(4))
def test_no_stretch_with_a_repeated_window_is_left_out(seed):
    rnd = random.Random(seed)
    texts = []
    for shared in (WINDOW - 1, WINDOW, WINDOW, WINDOW + 1, 450, 700):  # the edges of a passage fall anywhere around a key's gram
        passage = noise(rnd, shared)
        texts += [noise(rnd, rnd.randrange(300)) + passage + noise(rnd, rnd.randrange(300)) for _ in range(3)]
    again = noise(rnd, 410)
    texts += [again + noise(rnd, 50) + again, noise(rnd, 7) * 120, b"ab" * 300, b"a" * 500, noise(rnd, 900), b"", b"short"]
    by_key = stretches(texts)
    flat = [(k, p) for k, parts in by_key.items() for p in parts]
    parts = [p for _, p in flat]
    h = suffix_dedup._symbols()[np.frombuffer(b"".join(parts), dtype=np.uint8)]
    may = runs.meeting(h, np.array([len(p) for p in parts]), np.array([k for k, _ in flat]).view(np.uint64), WINDOW, GRAM)
    want = wanted(parts)
    assert any(want) and not all(want)
    assert all(m for m, w in zip(may.tolist(), want, strict=True) if w)
    got = suffix_dedup._sort_shard(table(by_key)).column("g").to_pylist()
    assert got == [i for i, w in enumerate(want) if w]


def test_stretches_that_share_little_are_not_sorted(monkeypatch):
    """Of 40 texts with one sentence in common and some with passages, only the stretches of the passages are sorted."""
    rnd = random.Random(9)
    sentence, passages = noise(rnd, 120), [noise(rnd, 900) for _ in range(3)]
    texts = [noise(rnd, 400) + sentence + noise(rnd, 400) for _ in range(40)]
    texts += [noise(rnd, 200) + p + noise(rnd, 200) for p in passages for _ in range(2)]
    by_key = {k: parts for k, parts in stretches(texts).items() if len(parts) > 1}
    assert sum(any(sentence[:60] in p or sentence[60:] in p for p in parts) for parts in by_key.values())
    assert sum(map(len, by_key.values())) >= 40
    seen, real = [], suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "repeated", lambda parts, *a: (seen.extend(parts), real(parts, *a))[1])
    out = suffix_dedup._sort_shard(table(by_key))
    assert 0 < out.num_rows <= len(seen) <= 24
    piece = WINDOW - (WINDOW - GRAM) // runs.SIDES  # what a stretch has to share
    assert all(any(p[k : k + piece] in x for x in passages for k in range(len(p) - piece + 1)) for p in seen)


def test_a_shard_without_candidates_is_empty():
    assert suffix_dedup.repeated([]) == []
    assert suffix_dedup._sort_shard(table({1: [b"a" * 450], 2: [b"b" * 450]})).num_rows == 0


def test_doubling_sorts_on_only_what_is_not_settled(monkeypatch):
    """The names of one repeated part are sorted on, those that are settled are not sorted again."""
    rnd = np.random.default_rng(3)
    part = rnd.integers(1, 50, 64)
    t = np.concatenate([part, rnd.permutation(4000) + 100, part])
    sizes, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (sizes.append(len(x)), real(x, *a, **k))[1])
    order = suffix_dedup._doubling(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sum(sizes[1:]) < len(t)
