"""Windows are compared many at a time, with the same lengths as one by one."""

import random

import numpy as np

from loomstone.operators import citations as C


def test_windows_at_once_as_one_by_one(monkeypatch):
    pick = random.Random(5)
    monkeypatch.setattr(C, "FIRST", 3)
    monkeypatch.setattr(C, "CELLS", 1)
    for n in (1, 61, 62, 63, 124, 130, 600):
        a, text = ("".join(pick.choice("abcdeß ") for _ in range(k)) for k in (n, 900))
        start = np.array(sorted(pick.sample(range(880), 20)))
        end = np.minimum(start + np.array([pick.randint(1, 700) for _ in start]), len(text))
        got = C.common_with(a, np.frombuffer(text.encode("utf-32-le"), np.uint32), start, end)
        assert got.tolist() == [C.common(a, text[i:j]) for i, j in zip(start, end, strict=True)]


def test_places_and_stems():
    text = "Straße ﬁnal  fin Finality ½ x²"
    normal, place = C.normal_form(text)
    pieces = [(f, k) for k, c in enumerate(text) for f in C._FOLDS[ord(c)]]
    kept = [(c, k) for n, (c, k) in enumerate(pieces) if c != " " or n and pieces[n - 1][0] != " "]
    assert normal == "".join(c for c, _ in kept).strip() and [text[k] for k in place][:6] == list("Straßß")
    words = C.Source(text).normal.split()
    for stem in {w[: C.STEM] for w in words} | {"none"}:
        assert C.Source(text).with_stem(stem).tolist() == [k for k, w in enumerate(words) if w[: C.STEM] == stem]
