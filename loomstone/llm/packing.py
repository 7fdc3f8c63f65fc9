"""Best-fit packing: tokenised documents go into as few sequences as best-fit decreasing finds.

Method: best-fit decreasing with a segment tree over remaining capacities, which
gives the tightest open bin for an item in logarithmic time.  Lengths are whole
numbers up to the capacity, so items of one length are alike and so are bins with
the same room: the driver places whole runs of items into whole runs of bins, from
the histogram of lengths alone (at most ``capacity`` rows).  The result is that of
placing the items one by one.  Each item then finds its place by its rank among
the items of its length; ranks come from counts by (length, bucket), so that a
length which a third of all rows share is still spread over all buckets.

Defined results: a null or empty text is the single end id; a document longer than
the capacity is cut into full pieces and a last one that may be shorter; repeated
rows are packed as documents of their own, and rows equal in id, text and piece take
their places in any order; a null id comes with the others; an empty table gives no
rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encoder, texts_of
from .common import buckets_for, chunks, documents, rows, staged

CAPACITY = 4096
END_ID = 1


class Room:
    """Segment tree over remaining capacities: how many runs of bins have exactly so much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least ``length`` that an open bin has; -1 where none has."""
        k = length + self.leaves
        if self.count[k]:
            return length
        while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until a right neighbour has bins
            k >>= 1
        if k <= 1:
            return -1
        k += 1
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, offset in the bin, items a bin) and the number of bins.

    Items of a length take ranks from 0; a row holds up to the next row's first rank.
    """
    tree, runs = Room(capacity), [[] for _ in range(capacity + 1)]
    plan, bins = [], 0

    def put(room: int, start: int, count: int) -> None:
        runs[room].append((start, count))
        tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                count = -(-left // each)
                start, bins = bins, bins + count
            else:
                start, count = runs[room].pop()
                tree.add(room, -1)
                each = room // length
            plan.append((length, rank, start, capacity - room, each))
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            if full:
                put(room - each * length, start, full)
            if rest:
                put(room - rest * length, start + full, 1)
            if (over := count - full - bool(rest)) > 0:
                put(room, start + full + bool(rest), over)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(plan, dtype=np.int64).reshape(-1, 5), bins


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, th, piece, start, length, ids_crc32 of every piece."""

    def run(batches):
        e = encoder(tokenizer)
        for b in chunks(batches):
            ids, ends = e.encode(texts_of(b.column("text")))
            raw, begin, out = ids.astype("<u4"), 0, []
            end_bytes = np.array([end_id], dtype="<u4").tobytes()
            for d, th, end in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), ends.tolist(), strict=True):
                own = raw[begin:end].tobytes() + end_bytes
                begin = end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    cut = own[at : at + 4 * capacity]
                    out.append((d, th, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "th", "piece", "start", "length", "ids_crc32"])

    return rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``, of a table that reads alike each time) with sequence_id and offset."""
    spark = items.sparkSession
    counts = items.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.collect()}  # at most ``capacity`` rows
    plan, _ = best_fit_decreasing(histogram, capacity)
    n = buckets_for(spark, sum(histogram.values()), 200_000)
    salted = items.withColumn("bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(n)))
    by_bucket = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    keys = plan[:, 0] * (1 << 42) + plan[:, 1]
    by_key = np.argsort(keys, kind="stable")
    keys, plan = keys[by_key], plan[by_key]
    columns = items.columns

    def place(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c), dtype=np.int64) for c in ("length", "rank"))
            p = plan[np.searchsorted(keys, length * (1 << 42) + rank, side="right") - 1]
            k = rank - p[:, 1]
            sequence, offset = p[:, 2] + k // np.maximum(p[:, 4], 1), p[:, 3] + k % np.maximum(p[:, 4], 1) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return ranked.select(*items.columns, F.col("rank").cast("long")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place: doc_id, th, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit_pack(staged(token_pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces"), ["doc_id", "th", "piece"], capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).drop("th")
