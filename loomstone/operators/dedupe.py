"""First wins, over whole tables: a row stays unless an earlier row that stays is its copy or close to it.

Closeness is not transitive and a dropped row drops no other, so rows are decided in
passes: one is dropped once an earlier close row stays, and stays once all earlier
close rows are dropped.  Every pass decides the first open row of every group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import fingerprints as P
from .graph import cut

#: Characters of a text below which only exact copies count.
LEAST_CHARS = 64


def first_wins(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, stays) of all rows (id) given their close pairs (a, b), a before b."""
    edges = cut(pairs.select("a", "b").distinct())
    state = cut(rows.select("id").join(edges.select(F.col("b").alias("id")).distinct().withColumn("has", F.lit(True)), "id", "left").select("id", F.when(F.col("has").isNull(), True).alias("stays")))
    while state.where("stays is null").limit(1).count():
        before = edges.join(state.select(F.col("id").alias("a"), "stays"), "a").groupBy(F.col("b").alias("id"))
        seen = before.agg(F.max(F.coalesce("stays", F.lit(False))).alias("kept"), F.max(F.col("stays").isNull()).alias("open"))
        decided = F.when(F.col("kept"), False).when(~F.col("open"), True)
        state = cut(state.join(seen, "id", "left").select("id", F.coalesce("stays", decided).alias("stays")))
    return state


def ingest(chunks: DataFrame, corpus: DataFrame, least_chars: int = LEAST_CHARS, most: int = 3) -> DataFrame:
    """(id, drop_reason) of chunks (id in order, document, text); null stays.

    ``empty``; ``exact_duplicate_run`` of an earlier chunk that stays;
    ``exact_duplicate_corpus`` of an indexed chunk (digest, owner) of another document;
    ``near_duplicate`` of an earlier chunk that stays, for texts of ``least_chars``.
    """
    c = chunks.select("id", "document", F.trim(T.text_of("text")).alias("text")).withColumn("digest", T.exact_hash("text"))
    c = cut(c.join(corpus.groupBy("digest").agg(F.min("owner").alias("owner")), "digest", "left").withColumn("foreign", (F.col("text") != "") & F.coalesce(F.col("owner") != F.col("document"), F.lit(False))))
    own = c.where("text <> '' and not foreign")
    first = own.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"))
    prints = cut(P.simhash(first.where(F.length("text") >= least_chars), "id", "text"))  # used three times
    # A later row of an equal fingerprint never stays: what drops the first of them is as close to the others.
    later = P.members(prints).where("id <> representative").select("id", F.lit(False).alias("never"))
    near = P.near_pairs(prints, most).select("a", "b")
    stays = first_wins(first.select("id"), near).join(later, "id", "left").select("id", F.coalesce("never", "stays").alias("stays"))
    known = first.select("digest", F.col("id").alias("first")).join(stays.withColumnRenamed("id", "first"), "first")
    out = c.join(known, "digest", "left")
    seen = F.coalesce(F.col("stays") & (F.col("first") < F.col("id")), F.lit(False))
    reason = F.when(F.col("text") == "", "empty").when(seen, "exact_duplicate_run").when(F.col("foreign"), "exact_duplicate_corpus").when(~F.col("stays"), "near_duplicate")
    return out.select("id", reason.alias("drop_reason"))


def retrieved(candidates: DataFrame, least_chars: int = LEAST_CHARS, most: int = 3) -> DataFrame:
    """(grp, pos, id, reason) of the candidate lists (grp, pos, id, text), best first; short texts are only compared as a whole."""
    return P.greedy(candidates, "grp", "pos", "text", most, least_chars)


def by_owner(docs: DataFrame, owned: Column) -> DataFrame:
    """(digest, owner): what is indexed already."""
    return docs.where(owned).groupBy(T.exact_hash("text").alias("digest")).agg(F.min("doc_id").alias("owner"))
