"""Sessions, long-term memories and the plan cache, as tables of turns, memories and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import cosine

DECAY_A_DAY, FADED, CAP, RECALLED = 0.01, 0.25, 500, 6
SIMILAR, SUPERSEDES, HIT = 0.94, 0.9, 0.05


def newest(turns: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    return turns.withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_back") <= n).drop("_back")


def suppressible(turns: DataFrame, keep_live: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Live, unpinned turns outside the newest ``keep_live`` live ones."""
    live = turns.where("pinned or not suppressed").withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
    return live.where((F.col("_back") > keep_live) & ~F.col("pinned")).drop("_back")


def decayed(salience: Column, last_used: Column, now: int) -> Column:
    """Salience less a hundredth for each day since the last use, within 0 and 1."""
    days = (F.lit(now) - last_used) / 86400
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), salience - DECAY_A_DAY * F.greatest(days, F.lit(0.0))))


def recall(queries: DataFrame, memories: DataFrame, now: int, k: int = RECALLED) -> DataFrame:
    """(user, id, score): nearest 4k of the user's unexpired memories, faded ones out, then likeness and salience weighed."""
    live = memories.where(F.col("expires").isNull() | (F.col("expires") > now))
    j = live.join(queries, "user").withColumn("sim", F.round(cosine("vector", "qv"), 9))
    near = j.withColumn("_r", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("sim"), "id"))).where(F.col("_r") <= 4 * k)
    s = near.withColumn("salience", decayed(F.col("salience"), F.col("last_used"), now)).where(F.col("salience") >= FADED)
    s = s.withColumn("score", F.round(0.7 * F.col("sim") + 0.3 * F.col("salience"), 6))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k).select("user", "id", "score", "place")


def evict(entries: DataFrame, bucket: str, now: int, cap: int) -> DataFrame:
    """What stays: unexpired entries, of a full bucket those with most hits, then latest use."""
    live = entries.where(F.col("created") + F.col("ttl") > now)
    w = Window.partitionBy(bucket).orderBy(F.desc("hits"), F.desc("last_used"), "id")
    return live.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
