"""Holds operator 9 against brute force over a whole folder: every window of every text hashed, and all hashes sorted.

    python tests/llm/windows_by_sort.py /root/testdata/check_s

It takes about 25 bytes of memory for each byte of text.
"""

import hashlib
import os
import sys

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")

WINDOW, BASE = 400, 0x9E3779B97F4A7C15


def window_hashes(data: bytes) -> np.ndarray:
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - WINDOW, pow(BASE, -1, 1 << 64), np.uint64)]))
        codes = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(11)) * np.uint64(0xC2B2AE3D27D4EB4F)
        codes ^= codes >> np.uint64(31)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up, dtype=np.uint64)])
        return (sums[WINDOW:] - sums[:-WINDOW]) * down


def brute(texts: dict[int, bytes]) -> dict[int, tuple]:
    order = sorted(texts)
    each = [window_hashes(texts[i]) for i in order]
    every = np.concatenate(each)
    by = np.argsort(every, kind="stable")
    same = every[by][1:] == every[by][:-1]
    again = np.zeros(len(every), bool)
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    out, at = {}, 0
    for i, h in zip(order, each, strict=True):
        hit, data = again[at : at + len(h)], texts[i]
        at += len(h)
        change = np.zeros(len(data) + 1, np.int64)
        starts = np.flatnonzero(hit)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
        gone = np.cumsum(change)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) > 0).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def main(folder: str) -> int:
    from pyspark.sql import SparkSession

    from loomstone.llm import suffix_dedup

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "24").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, folder).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toLocalIterator()}
    spark.stop()
    want = brute(texts)
    wrong = [i for i in want if got.get(i) != want[i]]
    print(f"{len(want)} documents, {sum(x[1] > 0 for x in want.values())} lose bytes, {len(wrong)} differ: {wrong[:5]}")
    return int(bool(wrong) or set(got) != set(want))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
