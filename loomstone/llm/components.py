"""Connected components of an edge table, without bringing edges anywhere.

Alternating stars: every node first points its larger neighbours, then its smaller
ones, at the least node it knows.  Each pass is two grouped minima over the edges
and is written to the shared folder; passes go on until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, staged, temporary


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node of its component) of every node of ``edges`` (columns a, b: long)."""
    with temporary(edges.sparkSession, large=False):
        now = lasting(_stars(edges), "stars")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def _stars(edges: DataFrame) -> DataFrame:
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        now = staged(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now


def _mark(edges: DataFrame) -> tuple:
    """Number and a checksum of the edges; equal marks mean that a pass changed nothing."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0] or 0, r[1]
