"""A corpus from raw documents to packed sequences, stage by stage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but
the last return the columns of documents, whatever their names.

Defined results, by stage: (language) a document whose text is null, empty or without
letters goes, one of several languages goes if none has half the letters; (lines) a
text that loses all lines is empty, and stays; (similarity) of rows of one id and text
one stays, documents without words all stay, and of a group one stays, of null ids only
if all its ids are null; (substrings) a null text stays null; (packing) a null text
is an empty one.  Empty tables give empty tables.  Repeated rows are judged one by one
but for similarity.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import jaccard_join, language_id, line_dedup, packing, substring_dedup
from loomstone.llm.common import documents, lean, release, scope, staged

#: A document is rejected where no language has this share of its letters.
LEAST_SHARE = 0.5
#: SQL cannot express these stages; tests/llm holds each against brute force.
ORACLE_SQL = None


def _back(out: DataFrame, docs: DataFrame, kept: list[str], new: dict) -> DataFrame:
    """The columns of ``docs`` again: ``new`` ones by name, the others from the kept columns."""
    return out.select(*((new[c] if c in new else F.col(f"_k{kept.index(c)}")).alias(c) for c in docs.columns))


def _others(docs: DataFrame, *own: str) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", *own)]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of which no language has half the letters, go; missing labels are filled in."""
    lean(spark)
    kept = _others(docs)
    model = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, model, spans=False, keep=kept).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return _back(out, docs, kept, {"doc_id": F.col("doc_id"), "lang": F.coalesce(F.col(f"_k{kept.index('lang')}"), "lang_pred")})


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents have."""
    lean(spark)
    kept = _others(docs, "text", "n_chars")
    out = line_dedup.line_dedup(docs, keep=kept)
    return _back(out, docs, kept, {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")})


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the one of least id, and of equal ids that of the least hash of its text."""
    lean(spark)
    found = jaccard_join.jaccard_join(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    one = found.where("n_shingles > 0").groupBy("group_key").agg(F.min(row).alias("r")).select("r.doc_id", "r.th")
    stay = one.union(found.where("n_shingles = 0").select("doc_id", "th").distinct()).select(F.struct("doc_id", "th").alias("key"))
    # The columns go through as one, so that no name of theirs can clash; one key for join and copies moves the texts once.
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    own = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return own.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def by_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the stretches of words that an earlier document has; texts that lose nothing stay as they are."""
    lean(spark)
    kept = _others(docs, "n_chars")
    out = substring_dedup.substring_dedup(docs, keep=kept)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"_k{kept.index('text')}"))
    return _back(out, docs, kept, {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")})


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    lean(spark)
    return packing.pack_documents(docs).drop("th")


STAGES = [
    ("language", by_language),
    ("lines", by_lines),
    ("similarity", by_similarity),
    ("substrings", by_substrings),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own, before = documents(spark, sf_dir), uuid.uuid4().hex, None
    for name, stage in STAGES[:-1]:
        with scope(key := (own, name)):
            docs = staged(stage(spark, docs, sf_dir), name)
        if before:
            release(spark, before)  # the stage before has been read and written anew
        before = key
    return STAGES[-1][1](spark, docs, sf_dir)
