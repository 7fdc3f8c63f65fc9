"""Where two texts can have a window of symbols in common, found with linear work.

A window of ``width`` symbols has as its key the least hash among its grams of
``gram`` symbols.  Equal windows have equal keys, so only windows of one key need be
compared.  Consecutive windows of a text mostly share their key; such a run is one
row: its key, where it starts, how many windows it has, and a hash of the symbols
that it covers.  A text has about 2 / (width - gram + 2) runs a symbol.
"""

from __future__ import annotations

import numpy as np

from .common import held, mixed

_BASE = 0x5851F42D4C957F2D


KEPT = 1 << 21


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, ``n`` of them at least; the longest so far up to ``KEPT`` stay."""
    if n > KEPT:
        return _new_powers(n)
    kept = held("powers", list)
    if not kept or len(kept[0]) <= n:
        kept[:] = _new_powers(n)
    return kept[0], kept[1]


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64))])
        down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))])
    return up, down


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit symbols."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = _powers(1 << int(np.ceil(np.log2(max(16, len(h) + 1)))))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])

    def grams(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k], 4)

    def stretches(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64), 6)

    def alike(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``n`` symbols from ``a`` and from ``b`` are the same."""
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours: suffix minima of one block and prefix minima of the next."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w) + 1
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(blocks, w)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def runs(h: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(sequence, start in it, windows, key, hash of the covered symbols, key found twice) of all runs of sequences that lie in ``h`` one after another.

    A run can only match itself if the gram of its key is there twice.
    """
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.bool_))
    if len(h) < width:
        return empty
    r = Rolling(h)
    all_ = r.grams(gram)
    key = sliding_min(all_, width - gram + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[: len(key)] == owner[width - 1 :]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1 : len(key)] != owner[: len(key) - 1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    if not len(start):
        return empty
    # A run ends where the next begins or its sequence has no more windows.
    edge = np.flatnonzero(new | ~inside)
    stop = np.append(edge, len(key))[np.searchsorted(edge, start, side="right")]
    begin = np.cumsum(sizes) - sizes
    own = owner[start]
    ends = (stop + width - gram).tolist()
    twice = np.fromiter((np.count_nonzero(all_[i:j] == k) > 1 for i, j, k in zip(start.tolist(), ends, key[start], strict=True)), dtype=np.bool_, count=len(start))
    return own, start - begin[own], stop - start, key[start], r.stretches(start, stop + width - 1), twice


#: Ways in which a window can lie around the gram of its key, for ``meeting``.
SIDES = 4


def meeting(h: np.ndarray, sizes: np.ndarray, keys: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Which stretches can hold a window that starts again in these stretches; they lie in ``h`` one after another.

    Two equal windows have their key's first gram at the same place, so around that gram
    they share what all windows have there: ``reach`` symbols, of which at least ``i``
    steps lie before it and all but ``i + 1`` steps after it, for some ``i``.  A stretch
    none of whose such pieces is there twice has no window that is; all others stay.
    """
    may = np.zeros(len(sizes), dtype=bool)
    if len(h) < width:
        return may
    r = Rolling(h)
    end = np.cumsum(sizes)
    found = r.grams(gram)
    at = np.flatnonzero(found == np.repeat(keys, sizes)[: len(found)])
    own = np.searchsorted(end, at, side="right")
    reach = width - gram
    step = -(-reach // SIDES)
    for i in range(SIDES):
        low, high = at - i * step, at + gram + max(0, reach - (i + 1) * step)
        whole = np.flatnonzero((low >= (end - sizes)[own]) & (high <= end[own]))
        piece = r.stretches(low[whole], high[whole])
        by = np.argsort(piece)
        same = piece[by][1:] == piece[by][:-1]
        may[own[whole[by[1:][same]]]] = True
        may[own[whole[by[:-1][same]]]] = True
    return may


def covered(hit: np.ndarray, width: int) -> np.ndarray:
    """Which symbols the windows marked in ``hit`` (one flag a window start) cover."""
    change = np.zeros(len(hit) + width, dtype=np.int64)
    change[: len(hit)] += hit
    change[width:] -= hit
    return np.cumsum(change)[:-1] > 0


def spans(mark: np.ndarray) -> list[int]:
    """Starts and ends of the stretches that are set, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))).tolist()
