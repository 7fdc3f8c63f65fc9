"""Links within families of nodes, for families of any size.

A family is a set of nodes among which links may be; a node can be in several.  Up
to ``BLOCK`` nodes are one task's work.  A larger family is dealt out in blocks, each
with the same few pivots; then what lies outside the family's largest class so far is
compared with everything else.  Nodes of one class need no more comparing, so a group
of near copies costs its size, and every link is either found or within a class.
A task gives links outwards, a row for each node that it reaches, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for
from .components import components

#: Nodes of a family in one task, and those of a larger family that all its tasks get.
BLOCK, PIVOTS = 256, 16


def _linked(dealt: DataFrame, link: Callable) -> DataFrame:
    """Edges (a, b) from rows (family, parts, node, body): each part is one task's work."""

    def run(batches):
        key, held = None, {}

        def flush():
            pairs = link(list(held), list(held.values()))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for *now, node, body in zip(*(b.column(c).to_pylist() for c in ("family", "part", "node", "body")), strict=True):
                if now != key:
                    if len(held) > 1:
                        yield flush()
                    key, held = now, {}
                held[node] = body
        if len(held) > 1:
            yield flush()

    each = dealt.select("family", F.explode("parts").alias("part"), "node", "body").repartition(buckets_for(dealt.sparkSession, 1, 1), "family", "part")
    return each.sortWithinPartitions("family", "part", "node").mapInArrow(run, "a long, b long")


def _block(column, blocks):
    return F.pmod(F.xxhash64(column, F.lit(3)), blocks).cast("int")


def _first_round(members: DataFrame) -> DataFrame:
    """Small families whole; of larger ones each block, with the pivots of the family."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    pivot = (F.col("members") > BLOCK) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("members")) < PIVOTS)
    return members.withColumn("parts", F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(_block("node", blocks))))


def _second_round(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Of large families: what the first round left outside the largest class, against all others."""
    label = members.join(linked, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    top = label.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    both = label.join(top, "family").withColumn("lb", F.ceil(F.col("top.c") / BLOCK).cast("int")).withColumn("rb", F.ceil((F.col("members") - F.col("top.c")) / BLOCK).cast("int"))
    lb, rb = F.col("lb"), F.col("rb")
    inside, outside = _block("node", lb), _block("node", rb)
    of_class = F.transform(F.sequence(F.lit(0), rb - 1), lambda r: inside * rb + r)
    others = F.transform(F.filter(F.sequence(F.lit(0), rb - 1), lambda r: r != outside), lambda r: lb * rb + F.least(r, outside) * rb + F.greatest(r, outside))
    of_rest = F.concat(F.transform(F.sequence(F.lit(0), lb - 1), lambda k: k * rb + outside), others)
    return both.withColumn("parts", F.when(F.col("label") == F.col("top.label"), of_class).otherwise(of_rest)).select("node", "family", "parts")


def linked_families(members: DataFrame, bodies: DataFrame, link: Callable) -> DataFrame:
    """``node`` and ``component`` of the nodes that are linked.

    ``members`` has node, family and members (the family's size), ``bodies`` node and
    body (binary); ``link`` takes nodes and bodies of a part and returns pairs
    (node, another node of its class), enough to join each class of the part.
    """
    found = components(_linked(_first_round(bodies.join(members, "node")), link))
    large = members.where(F.col("members") > BLOCK)
    if not large.limit(1).count():
        return found
    again = _linked(bodies.join(_second_round(large, found), "node"), link)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(again))
