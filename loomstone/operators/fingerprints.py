"""Fingerprints of near-equal texts: votes of shingle hashes by bit, bands, pairs, greedy dedupe."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from .graph import spread

#: Words of a shingle.
WIDTH = 4


def simhash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``simhash``: bit k is set where more shingle hashes have it than not; nothing for a text without words.

    A hash is the first 60 bits of an MD5, so that any engine can repeat it and no sign
    is in the way.  All votes of a document are where its text is: nothing is shuffled.
    """
    d = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).select("id", T.normal("t").alias("t"))

    def run(batches):
        for b in batches:
            keep, out = [], []
            for k, text in enumerate(b.column("t").to_pylist()):
                w = [x for x in text.split(" ") if x]
                if not w:
                    continue
                runs = w if len(w) <= WIDTH else map(" ".join, zip(*(w[i:] for i in range(WIDTH)), strict=False))
                h = np.frombuffer(b"".join([hashlib.md5(x.encode()).digest()[:8] for x in runs]), dtype=">u8") >> 4
                votes = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                keep.append(k)
                out.append(int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big"))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())), pa.array(out, pa.int64())], names=["id", "simhash"])

    return d.mapInArrow(run, StructType([d.schema["id"], StructField("simhash", LongType())]))


#: Blocks of a fingerprint's bits; up to three bits apart, at least three of six are equal.
BLOCKS, BLOCK_BITS, EQUAL = 6, 10, 3


def keys(simhash: Column) -> Column:
    """A key for each choice of ``EQUAL`` blocks: 30 bits each, so that few fingerprints have one in common by chance."""
    block = [F.shiftrightunsigned(simhash, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for k in range(BLOCKS)]
    out = []
    for n, chosen in enumerate(combinations(range(BLOCKS), EQUAL)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, BLOCK_BITS).bitwiseOR(block[k])
        out.append(key)
    return F.array(*out)


def near_pairs(prints: DataFrame, most: int = BLOCKS - EQUAL) -> DataFrame:
    """(a, b, distance) with a < b of unlike fingerprints up to ``most`` bits apart, three at most.

    Equal fingerprints are taken once, as their least id, so that copies never meet each other.
    """
    if most > BLOCKS - EQUAL:
        raise ValueError(f"keys find distances up to {BLOCKS - EQUAL}")
    one = prints.groupBy("simhash").agg(F.min("id").alias("id"))
    keyed = one.select("id", "simhash", F.explode(keys(F.col("simhash"))).alias("key"))
    a, b = keyed.toDF("a", "sa", "key"), keyed.toDF("b", "sb", "key")
    pairs = a.join(b, "key").where("a < b").withColumn("distance", T.hamming("sa", "sb").cast("long")).where(F.col("distance") <= most)
    return pairs.select("a", "b", "distance").distinct()


def members(prints: DataFrame) -> DataFrame:
    """(id, representative) of every fingerprint: the least id that has an equal one, which stands for it in ``near_pairs``."""
    least = prints.groupBy("simhash").agg(F.min("id").alias("representative"))
    return prints.join(least, "simhash").select("id", "representative")


def greedy(rows: DataFrame, group: str, order: str, text_col: str, most: int = 3, least_chars: int = 0) -> DataFrame:
    """First wins: a row goes if an earlier kept row of its group is equal, or close to it; kept rows have no reason.

    For the candidate list of one query, tens of rows; a row dropped as close is not compared with again.
    Texts under ``least_chars`` characters are only compared as a whole.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        exact, kept, reasons = set(), [], []
        for digest, hexed in zip(pdf["digest"], pdf["simhash"], strict=True):
            bits = int(hexed, 16) if hexed else None  # as hex, for a column of longs with nulls becomes floats
            near = next((d for k in kept if (d := (k ^ bits).bit_count()) <= most), None) if bits is not None else None
            if digest in exact:
                reasons.append("exact_duplicate")
            elif near is not None:
                reasons.append(f"near_duplicate:{near}")
            else:
                reasons.append(None)
                exact.add(digest)
                if bits is not None:
                    kept.append(bits)
        return pdf.assign(reason=reasons)[["grp", "pos", "id", "reason"]]

    base = rows.select(F.col(group).cast("string").alias("grp"), F.col(order).cast("long").alias("pos"), F.col("id"), F.col(text_col).alias("text"))
    known = base.join(simhash(base.dropDuplicates(["id"]), "id", "text"), "id", "left").select("grp", "pos", "id", T.exact_hash("text").alias("digest"), F.when(F.length("text") >= least_chars, T.hex16(F.col("simhash"))).alias("simhash"))
    return known.groupBy("grp").applyInPandas(fold, "grp string, pos long, id long, reason string")
