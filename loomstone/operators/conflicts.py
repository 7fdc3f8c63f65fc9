"""Conflicts among the candidates of a question: which pairs to look at, what they disagree on, which one holds.

A question's candidates are cut to a pool of the best scored before anything is
joined, so a group has at most ``pool`` rows whatever the corpus; the groups
themselves are dealt out.  Pairs come from clusters of like claims (links followed to
their end) and from pairs of at least half the likeness that disagree on a quantity or
a duty; both ends must be of different documents.

Of a cluster only the best ``most`` members of each of its ``most + 1`` best documents
can be in one of its ``most`` best pairs: a pair with any other member has that many
better ones beside it.  So clusters are cut to these before their members are paired.

Defined results: a null text has no terms and pairs with nothing; a null score counts
as 0; candidates of a null document are of no document and pair with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from . import folds
from .graph import classes
from .guardrails import resolve

#: Fixed: likeness of a cluster, the share of it from which on disagreement counts, clusters and pairs of a question.
LIKE, HALF, CLUSTERS, PAIRS = 0.82, 0.5, 6, 4
POOL, MOST_POOLED = 30, 1 << 10
FACTS = ("effective", "modified", "authority", "seen")


def pooled(candidates: DataFrame, pool: int = POOL) -> DataFrame:
    """The ``pool`` best candidates of each question, with their place from 0 and a number of their own."""
    if pool > MOST_POOLED:
        raise ValueError(f"a pool has at most {MOST_POOLED} candidates")
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "id")) - 1
    c = candidates.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0))).withColumn("place", place).where(F.col("place") < pool)
    return c.withColumn("node", F.col("grp") * MOST_POOLED + F.col("place"))


def weighted_terms(pool: DataFrame) -> DataFrame:
    """grp, node, term, idf: the distinct terms of each candidate, weighed within its question."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS)))
    each = pool.select("grp", "node", F.explode(words).alias("term"))
    n = pool.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    df = each.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "grp")
    return each.join(df, ["grp", "term"]).select("grp", "node", "term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def likenesses(terms: DataFrame) -> DataFrame:
    """grp, a, b, likeness: shared weight over the lesser weight, of the pairs of a pool that share a term."""
    mass = terms.groupBy("grp", "node").agg(F.sum("idf").alias("mass"))
    own, other = terms.withColumnRenamed("node", "a"), terms.select("grp", F.col("node").alias("b"), "term")
    both = own.join(other, ["grp", "term"]).where("a < b").groupBy("grp", "a", "b").agg(F.sum("idf").alias("both"))
    m = lambda side: mass.select("grp", F.col("node").alias(side), F.col("mass").alias(f"m{side}"))
    return both.join(m("a"), ["grp", "a"]).join(m("b"), ["grp", "b"]).select("grp", "a", "b", (F.col("both") / F.least("ma", "mb")).alias("likeness"))


def clusters(pool: DataFrame, like: DataFrame, least: float = LIKE, most: int = CLUSTERS) -> DataFrame:
    """grp, node, cluster of the ``most`` largest clusters of two and more of each question; of equal size the one of better candidates."""
    found = classes(pool.select(F.col("node").alias("id")), like.where(F.col("likeness") >= least)).withColumnRenamed("id", "node")
    each = found.join(pool.select("grp", "node"), "node")
    size = each.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("size"), "cluster"))
    return each.join(size.withColumn("place", place).where(F.col("place") <= most).select("grp", "cluster"), ["grp", "cluster"])


def _side(pool: DataFrame, side: str) -> DataFrame:
    return pool.select("grp", F.col("node").alias(side), F.col("document").alias(f"{side}_document"), F.col("score").alias(f"{side}_score"), F.col("text").alias(f"{side}_text"))


def _best(pairs: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """The ``most`` best pairs of each group, by summed score, then by their places."""
    w = Window.partitionBy(*by).orderBy(F.desc("total"), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _cluster_pairs(pool: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """grp, a, b, total: the best pairs of each cluster, from the members that can be in one."""
    m = members.join(pool.select("grp", "node", "document", "score"), ["grp", "node"]).where("document IS NOT NULL")
    m = m.withColumn("own", F.row_number().over(Window.partitionBy("grp", "cluster", "document").orderBy(F.desc("score"), "node"))).where(F.col("own") <= most)
    # Documents by their best members: the place of each counts the best members before it.
    lead = F.sum(F.when(F.col("own") == 1, 1).otherwise(0)).over(Window.partitionBy("grp", "cluster").orderBy(F.desc("score"), "node"))
    rank = F.min(F.when(F.col("own") == 1, F.col("lead"))).over(Window.partitionBy("grp", "cluster", "document"))
    m = m.withColumn("lead", lead).withColumn("rank", rank).where(F.col("rank") <= most + 1)
    side = lambda s: m.select("grp", "cluster", F.col("node").alias(s), F.col("document").alias(f"{s}_document"), F.col("score").alias(f"{s}_score"))
    pairs = side("a").join(side("b"), ["grp", "cluster"]).where("a < b AND a_document <> b_document").withColumn("total", F.col("a_score") + F.col("b_score"))
    return _best(pairs, ("grp", "cluster"), most).select("grp", "a", "b", "total")


def _judged(pairs: DataFrame) -> DataFrame:
    """Pairs (grp, a, b, total, a_text, b_text) with the kind and confidence of their conflict, without the texts."""

    def run(batches):
        for pdf in batches:
            got = [folds.conflict(a or "", b or "") for a, b in zip(pdf["a_text"], pdf["b_text"], strict=True)]
            yield pdf[["grp", "a", "b", "total"]].assign(kind=[k for k, _ in got], confidence=[c for _, c in got])

    return pairs.select("grp", "a", "b", "total", "a_text", "b_text").mapInPandas(run, "grp long, a long, b long, total double, kind string, confidence double")


def conflict_pairs(candidates: DataFrame, pool: int = POOL, most: int = PAIRS, least: float = LIKE) -> DataFrame:
    """grp, rank, a, b (ids), total, kind, confidence: the pairs worth a look of each question, the best scored first.

    ``candidates`` has (grp long, id, document, score, text).  ``kind`` is ``none`` where
    two like claims do not disagree.
    """
    p = pooled(candidates, pool)
    like = likenesses(weighted_terms(p)).where(F.col("likeness") >= HALF * least)
    same = _cluster_pairs(p, clusters(p, like, least), most)
    weaker = like.where(F.col("likeness") < least).join(_side(p, "a"), ["grp", "a"]).join(_side(p, "b"), ["grp", "b"]).where("a_document <> b_document")
    weaker = _judged(weaker.withColumn("total", F.col("a_score") + F.col("b_score"))).where("kind <> 'none'")
    chosen = _best(same.union(weaker.select(*same.columns)).distinct(), ("grp",), most)
    texts = chosen.join(_side(p, "a").select("grp", "a", "a_text"), ["grp", "a"]).join(_side(p, "b").select("grp", "b", "b_text"), ["grp", "b"])
    told = _judged(texts).join(chosen.select("grp", "a", "b", "rank"), ["grp", "a", "b"])
    name = lambda s: p.select("grp", F.col("node").alias(s), F.col("id").alias(f"{s}_id"))
    return told.join(name("a"), ["grp", "a"]).join(name("b"), ["grp", "b"]).select("grp", "rank", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "total", "kind", "confidence")


def conflict_check(candidates: DataFrame, pool: int = POOL, most: int = PAIRS, least: float = LIKE, superseded_days: int = 180) -> DataFrame:
    """grp, rank (by confidence), current, other (ids), kind, confidence, basis, gap_days, superseded and note of every conflict.

    ``candidates`` also has when each took effect and was changed, its authority and
    when it was seen (``effective``, ``modified``, ``authority``, ``seen``); what these
    do not decide stays with the better scored.
    """
    found = conflict_pairs(candidates, pool, most, least).where("kind <> 'none'")
    facts = lambda s: candidates.select("grp", F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in FACTS))
    r = resolve("a", "b", superseded_days)
    j = found.join(facts("a"), ["grp", "a"]).join(facts("b"), ["grp", "b"])
    b_holds = F.coalesce(r["winner"] == "b", F.lit(False))
    out = j.select("grp", F.col("rank").alias("pair"), F.when(b_holds, F.col("b")).otherwise(F.col("a")).alias("current"), F.when(b_holds, F.col("a")).otherwise(F.col("b")).alias("other"), "kind", "confidence", r["by"].alias("basis"), r["gap_days"].alias("gap_days"), F.coalesce(r["superseded"], F.lit(False)).alias("superseded"))
    gap = F.coalesce(F.concat(F.lit(", "), F.round("gap_days", 1).cast("string"), F.lit(" days apart")), F.lit(""))
    status = F.when(F.col("superseded"), "superseded").otherwise("still in the corpus")
    note = F.concat(F.lit("["), F.col("current").cast("string"), F.lit("] is current (by "), F.col("basis"), gap, F.lit("); ["), F.col("other").cast("string"), F.lit("] is "), status, F.lit(" and must be cited for the disagreement."))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("confidence"), "pair"))
    return out.withColumn("rank", place).withColumn("note", note).drop("pair")
