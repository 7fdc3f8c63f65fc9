"""Document fingerprints that stay close under edits.

Method: a randomised embedding of edit distance into Hamming distance.  All texts
share one set of random walks: at step j the walk stands on a character and either
stays or moves on, by a random bit of (character, j); the embedded string is the
character at every step.  Texts that part at an edit meet again after a few steps,
so few edits leave most steps alike.  A fingerprint samples ``SAMPLES`` steps, each
uniform over the walk: sample k moves from step to step only as a walk grows longer
(the records of a running minimum), so texts of unlike lengths share most steps.
Four bits of a hash of the sampled character make one hex digit.  Bands of sampled
digits propose pairs and the share of equal digits verifies them; documents joined by
such links are a class, named by its least id.

Defined results: null is the empty text, whose fingerprint is all zeros; equal texts
have equal fingerprints; after the last document comes the first, and a document
alone is its own next; null ids come before all others, equal ids in the order of
a hash of their texts; an empty table gives no rows.  Columns are read by the names
given, others are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, documents, lasting, mixed, rows, ship, staged, sweep, temporary
from .families import linked_families

SAMPLES = 128
PERIOD = 4096
CHUNK_CHARS = 6 << 20
#: Walks over so few texts go one by one.
FEW = 48
BANDS, BAND_DIGITS, LIKE = 16, 6, 0.6


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Steps that a character takes from each phase of the walk, (256, PERIOD); steps of each sample, ascending."""
    rng = np.random.default_rng(20130)
    bits = rng.random((256, PERIOD)) < 0.5
    bits[:, -1] = True
    ahead = np.where(bits, np.arange(PERIOD), PERIOD - 1)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]
    steps = [[0] for _ in range(SAMPLES)]
    for own in steps:
        while own[-1] < 1 << 44:
            own.append(max(own[-1] + 1, int((own[-1] + 1) / max(rng.random(), 1e-12))))
    wide = max(map(len, steps))
    return (ahead - np.arange(PERIOD) + 1).astype(np.int16), np.array([x + [1 << 62] * (wide - len(x)) for x in steps], dtype=np.int64)


def symbols(text: str) -> np.ndarray:
    """Code points as 256 symbols; ASCII keeps apart."""
    if text.isascii():
        return np.frombuffer(text.encode(), dtype=np.uint8)
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return (code ^ (code >> np.uint32(8)) * np.uint32(151)).astype(np.uint8)


def walk(syms: np.ndarray, begin: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each symbol is reached, and the step after the last, of many walks that begin at steps ``at``."""
    jump, _ = tables()
    flat, mask = jump.ravel(), PERIOD - 1
    reached, step = np.zeros(len(syms), dtype=np.int64), at.astype(np.int64).copy()
    order = np.argsort(-n, kind="stable")
    length, pos, j = n[order], begin[order].copy(), step[order]
    t = 0
    while t < (length[FEW] if len(length) > FEW else 0):
        b = int(np.searchsorted(-length, -t, side="left"))
        # All of these texts have at least this many symbols more.
        for _ in range(int(length[b - 1]) - t):
            p, now = pos[:b], j[:b]
            reached[p] = now
            now += flat[(syms[p].astype(np.int64) << 12) + (now & mask)]
            p += 1
        t = int(length[b - 1])
    for k in range(min(FEW, len(length))):
        left = int(length[k]) - t
        if left > 0:
            now, out, base = int(j[k]), [], jump_rows()
            put = out.append
            for row in map(base.__getitem__, syms[pos[k] : pos[k] + left].tobytes()):
                put(now)
                now += row[now & mask]
            reached[pos[k] : pos[k] + left] = out
            j[k] = now
    step[order] = j
    return reached, step


@functools.lru_cache(maxsize=1)
def jump_rows() -> list[list[int]]:
    return tables()[0].tolist()


_SALT = mixed(np.arange(SAMPLES, dtype=np.uint64), 5)
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def digits(reached: np.ndarray, syms: np.ndarray, end: int) -> np.ndarray:
    """The sampled digits, 0 to 15, of a text whose symbols were reached at these steps."""
    if not len(syms):
        return np.zeros(SAMPLES, dtype=np.uint8)
    _, steps = tables()
    chosen = steps[np.arange(SAMPLES), (steps < end).sum(axis=1) - 1]
    seen = syms[np.searchsorted(reached, chosen, side="right") - 1].astype(np.uint64)
    return (mixed(seen ^ _SALT, 3) >> np.uint64(60)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal digits, less what chance gives."""
    return max(0.0, (float((a == b).mean()) - 1 / 16) * 16 / 15)


def text_of(d: np.ndarray) -> str:
    return _HEX[d].tobytes().decode()


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    own = [symbols(t) for t in texts]
    n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    begin, all_ = np.cumsum(n) - n, np.concatenate([*own, np.zeros(0, dtype=np.uint8)])
    reached, end = walk(all_, begin, n, np.zeros(len(own), dtype=np.int64))
    return [digits(reached[b : b + k], s, e) for b, k, s, e in zip(begin.tolist(), n.tolist(), own, end.tolist(), strict=True)]


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``after``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_edits(texts: list[str]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
    """Fingerprints of all texts; edited texts and their fingerprints of all but the last, each with the text after it."""
    own = [symbols(t) for t in texts]
    n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    begin, all_ = np.cumsum(n) - n, np.concatenate([*own, np.zeros(0, dtype=np.uint8)])
    reached, end = walk(all_, begin, n, np.zeros(len(own), dtype=np.int64))
    prints = [digits(reached[b : b + k], s, e) for b, k, s, e in zip(begin.tolist(), n.tolist(), own, end.tolist(), strict=True)]
    # The kept half walks as before; only what replaces the other half is walked anew.
    half = n[:-1] // 2
    kept = n[:-1] - half
    new = [s[:h] for s, h in zip(own[1:], half.tolist(), strict=True)]
    m = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
    tail, first = np.concatenate([*new, np.zeros(0, dtype=np.uint8)]), np.cumsum(m) - m
    from_step = np.where(half > 0, reached[np.minimum(begin[:-1] + kept, max(len(all_) - 1, 0))], end[:-1]) if len(all_) else end[:-1]
    again, stop = walk(tail, first, m, from_step)
    out_texts, out = [], []
    for k in range(len(texts) - 1):
        b, f = int(begin[k]), int(first[k])
        steps = np.concatenate([reached[b : b + kept[k]], again[f : f + m[k]]])
        out_texts.append(edited(texts[k], texts[k + 1]))
        out.append(digits(steps, np.concatenate([own[k][: kept[k]], new[k]]), int(stop[k])))
    return prints, out_texts, out


SCHEMA = "doc_id long, th long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches):
    """Rows sorted by bucket and id; a bucket ends with an extra row, the first document after it."""

    def flush(held):
        texts = [x[4] for x in held]
        prints, new, new_prints = with_edits(texts)
        out = [(x[2], x[3], len(x[4]), hashlib.sha256(new[k].encode()).hexdigest(), text_of(prints[k]), text_of(new_prints[k]), likeness(prints[k], new_prints[k]), likeness(prints[k], prints[k + 1])) for k, x in enumerate(held[:-1]) if not x[1]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    held, size = [], 0
    for b in batches:
        for row in zip(b.column("bucket").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
            row = (*row[:4], row[4] or "")
            held.append(row)
            size += len(row[4])
            if size >= CHUNK_CHARS and len(held) > 1:
                yield flush(held)
                held, size = [row], len(row[4])
    if len(held) > 1:
        yield flush(held)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, as SCHEMA: its fingerprint, that of its edited text, and the likeness to that and to the next document's."""
    spark = docs.sparkSession
    d = rows(docs, id_col, text_col)
    n = 3 * buckets_for(spark, 1, 1)
    cuts = sorted(set(d.select("doc_id").where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)) if n > 1 else []))
    bucket = F.lit(0)
    if cuts:
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(cuts))
    d = d.withColumn("own", bucket)
    # At most one row for each bucket comes to the driver.
    first = sorted(((r.own, r.f.doc_id, r.f.th) for r in d.groupBy("own").agg(F.min(F.struct("doc_id", "th")).alias("f")).collect()), key=lambda x: x[0])
    # The first document of a bucket also ends the one before, that of the first the last.
    ends = spark.createDataFrame([(*x[1:], first[k - 1][0]) for k, x in enumerate(first)], "e_id long, e_th long, bucket int")
    also = d.join(F.broadcast(ends), d.doc_id.eqNullSafe(F.col("e_id")) & (d.th == F.col("e_th"))).select("bucket", F.lit(True).alias("extra"), "doc_id", "th", "text")
    dealt = d.select(F.col("own").alias("bucket"), F.lit(False).alias("extra"), "doc_id", "th", "text").union(also)
    dealt = dealt.repartition(buckets_for(spark, 1, 1), "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "th")
    return dealt.mapInArrow(_neighbours, SCHEMA)


def _bucket(cuts: list[float]):
    """The number of cuts at or below the id."""
    edges = np.array([int(x) for x in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def below(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    return below(F.coalesce("doc_id", F.lit(0)))


def _link(like: float):
    """Pairs that join the fingerprints of a band's bucket that are alike, directly or by others of it."""

    def run(nodes: list[int], prints: list[bytes]) -> list[tuple[int, int]]:
        d = np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(nodes), SAMPLES // 2)
        d = np.concatenate([d >> 4, d & 15], axis=1)
        left, front, out = np.arange(1, len(nodes)), [0], []
        while front:
            # Each member once asks those that none has reached; where it ends, the next of them leads.
            k = front.pop()
            near = np.maximum(0.0, ((d[left] == d[k]).mean(axis=1) - 1 / 16) * 16 / 15) >= like
            out += [(nodes[j], nodes[k]) for j in left[near].tolist()]
            front += left[near].tolist()
            left = left[~near]
            if not front and len(left):
                front, left = [int(left[0])], left[1:]
        return out

    return run


def bands() -> list[list[int]]:
    """The places of the digits of each band: fixed samples."""
    rng = np.random.default_rng(77)
    return [sorted(rng.choice(SAMPLES, BAND_DIGITS, replace=False).tolist()) for _ in range(BANDS)]


def similar_prints(prints: DataFrame, like: float = LIKE) -> DataFrame:
    """``node`` (hash of a fingerprint) and ``component`` of the fingerprints linked to others.

    Two are linked if they agree in all digits of a band and pass verification.
    Fingerprints are taken once each, whatever their number of documents; the buckets
    of a band are families, whose links are followed outwards in blocks of bounded size.
    """
    spark = prints.sparkSession
    ship(spark)
    with temporary(spark):
        each = staged(prints.select("fingerprint").where("fingerprint is not null").distinct().select(F.xxhash64("fingerprint").alias("node"), "fingerprint"), "prints")
        keys = F.array(*(F.xxhash64(F.lit(k), F.concat(*(F.substring("fingerprint", p + 1, 1) for p in own))) for k, own in enumerate(bands())))
        banded = each.select("node", F.explode(keys).alias("family"))
        shared = banded.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        members = staged(banded.join(shared, "family"), "members")
        return lasting(linked_families(members, each.select("node", F.unhex("fingerprint").alias("body")), _link(like)), "linked")


def similar_classes(prints: DataFrame, like: float = LIKE) -> DataFrame:
    """Every row of ``prints`` with ``class_id``: the least doc_id of the documents that links lead to, its own where there are none."""
    linked = similar_prints(prints, like)
    node = F.xxhash64("fingerprint").alias("node")
    least = prints.groupBy(node).agg(F.min("doc_id").alias("least")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = least.groupBy("component").agg(F.min("least").alias("class_id"))
    named = least.join(of_class, "component").select(F.col("node").alias("_node"), F.col("class_id").alias("_class"))
    return prints.join(named, F.xxhash64("fingerprint") == F.col("_node"), "left").withColumn("class_id", F.col("_class")).drop("_node", "_class")


def query(spark, sf_dir: str) -> DataFrame:
    prints = staged(edit_fingerprints(documents(spark, sf_dir)).drop("th"), "fingerprints")
    sweep(spark)
    return similar_classes(prints)
