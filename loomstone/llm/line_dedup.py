"""Line deduplication: lines that many documents hold leave all of them.

Lines are exploded with their normalised keys hashed to 128 bits, distinct
documents are counted per hash (partial counts before the shuffle), frequent
hashes are joined back to the documents that hold them (broadcast up to
``MOST_BROADCAST`` hashes, beyond that salted, for one line may be in most
documents), and texts are put together again by position.

Defined results: a null or empty text is one empty line; an empty key (a blank
line) is never dropped; a document without lines left is an empty text; every
row counts as a document, repeated ids too; an empty table gives no rows.  Columns are
read by the names given, others pass as told.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, chunks, kept_schema, lasting, let_go, rows, staged, temporary, text_bytes, with_kept

MIN_DOCS = 10
#: Frequent hashes of 16 bytes that are broadcast at most, and the parts of each beyond that.
MOST_BROADCAST, SALTS = 500_000, 32


def key_of(line: bytes) -> bytes:
    return line.strip(SPACES).lower()


def _line_rows(batches):
    let_go()
    for b in chunks(batches):
        ids, ths, ks = [], [], []
        for d, th, t in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), text_bytes(b.column("text")), strict=True):
            own = {key_of(x) for x in t.split(b"\n")}
            own.discard(b"")
            ks += map(xxhash.xxh3_128_digest, own)
            ids += [d] * len(own)
            ths += [th] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(ks, pa.binary())], names=["doc_id", "th", "key"])


def _reassemble(batches):
    for b in chunks(batches):
        out = []
        for t, drop in zip(text_bytes(b.column("text")), b.column("drop").to_pylist(), strict=True):
            lines = t.split(b"\n")
            if drop:
                gone = set(drop)
                kept = [x for x in lines if not ((k := key_of(x)) and xxhash.xxh3_128_digest(k) in gone)]
            else:
                kept = lines
            out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        yield with_kept(
            b,
            [b.column("doc_id"), b.column("th"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())],
            ["doc_id", "th", "n_lines", "n_dropped", "kept"],
        )


def _held(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The lines whose key is frequent."""
    if frequent.count() <= MOST_BROADCAST:
        return lines.join(F.broadcast(frequent), "key", "left_semi")
    salt = F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")
    salted = frequent.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", salt).join(salted, ["key", "salt"], "left_semi").drop("salt")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, th, n_lines, n_dropped, kept (the text without its frequent lines)."""
    d = rows(docs, id_col, text_col, keep)
    with temporary(docs.sparkSession):
        lines = staged(d.select("doc_id", "th", "text").mapInArrow(_line_rows, "doc_id long, th long, key binary"), "lines")
        frequent = staged(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("key"), "frequent")
        # A copy of a row repeats its keys; collect_set keeps a document's list within its own distinct lines.
        drop = lasting(_held(lines, frequent).groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("th2")).agg(F.collect_set("key").alias("drop")), "drop")
    both = d.join(drop, d.doc_id.eqNullSafe(F.col("d2")) & (d.th == F.col("th2")), "left").drop("d2", "th2")
    return both.mapInArrow(_reassemble, "doc_id long, th long, n_lines long, n_dropped long, kept string" + kept_schema(d))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
