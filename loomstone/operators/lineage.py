"""Walks up a graph of parents, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def walk(edges: DataFrame, subjects: list[str], max_depth: int) -> DataFrame:
    """(subject, node, depth): what each of a few subjects comes from, each node at its least depth, cycles cut.

    Each level joins the frontier, of bounded subjects, with the edges, and is cut from
    what made it; the number of levels is bounded.
    """
    front = edges.where(F.col("child").isin(*subjects)).select(F.col("child").alias("subject"), F.col("parent").alias("node"), F.lit(1).alias("depth"))
    out = front
    for depth in range(2, max_depth + 1):
        front = front.join(edges, F.col("node") == F.col("child")).select("subject", F.col("parent").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = cut(front)
        out = out.union(front)
    return out.where("node <> subject").groupBy("subject", "node").agg(F.min("depth").alias("depth"))
