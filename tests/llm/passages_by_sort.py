"""Holds operator 9 against brute force over a large folder, and against passages of 50 words that other documents have too.

    python tests/llm/passages_by_sort.py /root/testdata/check_l RESULT

RESULT is a folder with the operator's rows as parquet.  Every window of 400 bytes is
hashed; the hashes, eight bytes for each byte of text, lie in memory that processes share.
"""

import hashlib
import mmap
import os
import re
import sys
from multiprocessing import Pool

import numpy as np
import pyarrow.dataset as ds
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from windows_by_sort import BASE, WINDOW, window_hashes  # noqa: E402

WORDS, PARTS, SLICE = 50, 32, 1 << 24
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_windows(data: bytes) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, WORD.findall(data)), np.uint64)
    if len(h) < WORDS:
        return h[:0]
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - WORDS, pow(BASE, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
        return (sums[WORDS:] - sums[:-WORDS]) * down


def hashed(rows: range) -> list[np.ndarray]:
    for i in rows:
        every[begin[i] : end[i]] = window_hashes(texts[i])
    return [word_windows(texts[i]) for i in rows]


def mark(part: int) -> None:
    at = np.concatenate([np.flatnonzero(every[k : k + SLICE] % np.uint64(PARTS) == part) + k for k in range(0, len(every), SLICE)])
    by = np.argsort(every[at])
    same = every[at[by]][1:] == every[at[by]][:-1]
    again[at[by[1:][same]]] = 1
    again[at[by[:-1][same]]] = 1


def wanted(rows: range) -> list[tuple]:
    out = []
    for i in rows:
        starts, data = np.flatnonzero(again[begin[i] : end[i]]), texts[i]
        change = np.zeros(len(data) + 1, np.int64)
        change[starts] += 1
        change[starts + WINDOW] -= 1
        gone = np.cumsum(change)[:-1] > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), int((np.diff(np.append(0, gone.astype(np.int8))) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def shared_words(each: list[np.ndarray]) -> np.ndarray:
    """Which documents have a window of words that another one has."""
    h, own = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
    out = np.zeros(len(each), bool)
    for part in range(8):
        at = np.flatnonzero(h % np.uint64(8) == part)
        if not len(at):
            continue
        by = at[np.argsort(h[at])]
        first = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
        unlike = np.minimum.reduceat(own[by], first) != np.maximum.reduceat(own[by], first)
        out[own[by][np.repeat(unlike, np.diff(np.append(first, len(by))))]] = True
    return out


if __name__ == "__main__":
    table = ds.dataset(f"{sys.argv[1]}/documents.parquet").to_table(columns=["doc_id", "text"])
    ids, texts = table.column("doc_id").to_pylist(), [(x or "").encode() for x in table.column("text").to_pylist()]
    windows = np.array([max(0, len(t) - WINDOW + 1) for t in texts])
    end = np.cumsum(windows)
    begin = end - windows
    every = np.frombuffer(mmap.mmap(-1, 8 * int(end[-1])), np.uint64)
    again = np.frombuffer(mmap.mmap(-1, int(end[-1])), np.uint8)
    some = [range(i, min(i + 1000, len(ids))) for i in range(0, len(ids), 1000)]
    with Pool(5) as pool:
        each = [x for y in pool.map(hashed, some, chunksize=1) for x in y]
        pool.map(mark, range(PARTS), chunksize=1)
        want = [x for y in pool.map(wanted, some, chunksize=1) for x in y]
    rows = ds.dataset(sys.argv[2], exclude_invalid_files=True).to_table().to_pydict()
    got = dict(zip(rows["doc_id"], zip(rows["n_bytes"], rows["n_removed"], rows["n_spans"], rows["kept_sha256"], strict=True), strict=True))
    wrong = [i for i, w in zip(ids, want, strict=True) if got.get(i) != w]
    print(f"{len(ids)} documents, {len(rows['doc_id'])} rows, {sum(w[1] > 0 for w in want)} lose bytes, {len(wrong)} differ: {wrong[:5]}")
    shared, less = shared_words(each), np.array([w[1] > 0 for w in want])
    print(f"{shared.sum()} share {WORDS} words with another, {(shared & less).sum()} of them lose bytes; of {(~shared).sum()} others {(~shared & ~less).sum()} lose none")
    sys.exit(bool(wrong) or len(rows["doc_id"]) != len(ids))
