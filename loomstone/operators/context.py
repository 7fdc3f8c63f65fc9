"""What leaves a prompt that is too large, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shed(items: DataFrame, need: DataFrame, floor: int = 2) -> DataFrame:
    """Every item (grp, kind, id, value, pos, tokens, pinned) with ``shed``: whether it goes to free the tokens (grp, need).

    The least valuable goes first: sources, weakest first, down to ``floor`` of them;
    memory lines from the last; the other sources; turns that are not pinned, oldest
    first; the summary.  Pinned turns stay.  Items go one by one until enough is freed.
    """
    weak = F.row_number().over(Window.partitionBy("grp", "kind").orderBy("value", F.desc("id")))
    many = F.count(F.lit(1)).over(Window.partitionBy("grp", "kind"))
    place = (
        F.when((F.col("kind") == "source") & (weak <= many - floor), 1).when(F.col("kind") == "memory", 2).when(F.col("kind") == "source", 3).when((F.col("kind") == "turn") & ~F.col("pinned"), 4).when(F.col("kind") == "summary", 5)
    )
    within = F.when(F.col("kind") == "source", weak).when(F.col("kind") == "memory", -F.col("pos")).otherwise(F.col("pos"))
    ordered = items.withColumn("_place", place).withColumn("_within", within)
    freed = F.sum(F.when(F.col("_place").isNotNull(), F.greatest(F.lit(1), "tokens")).otherwise(0)).over(Window.partitionBy("grp").orderBy(F.col("_place").asc_nulls_last(), "_within", "id").rowsBetween(Window.unboundedPreceding, -1))
    out = ordered.withColumn("_freed", F.coalesce(freed, F.lit(0))).join(need, "grp", "left")
    goes = F.col("_place").isNotNull() & (F.col("_freed") < F.coalesce("need", F.lit(0)))
    return out.withColumn("shed", goes).drop("_place", "_within", "_freed", "need")


def budget(window: Column, reserved: int = 16_000, sources: float = 0.55, memories: float = 0.08) -> tuple[Column, Column]:
    """Tokens for sources and for memories of a window, less what is kept free for the answer; shares are exact, not binary fractions."""
    room = window - reserved
    share = lambda x: F.floor(room * F.lit(x).cast("decimal(4,3)")).cast("long")
    return share(sources), share(memories)


def density(score: Column, novelty: Column, tokens: Column) -> Column:
    """What a source is worth for each of its tokens: its score, if positive, by how new it is."""
    return F.greatest(F.lit(0.0), score) * novelty / tokens


def compaction_reason(turns: Column, size: Column, most: int = 20, least: int = 4, every: int = 5, room: int = 2000, forced: Column | None = None) -> Column:
    """Why a session is compacted: forced, too many turns, each so many, or too large; never below ``least`` turns unless forced."""
    first = F.when(F.lit(False) if forced is None else F.coalesce(forced, F.lit(False)), "forced")
    return first.when(turns > most, "max_turns").when(turns < least, "none").when(turns % every == 0, "periodic").when(size > room, "ratio").otherwise("none")


def older_than(turns: DataFrame, by: str, order: str, live: int = 3) -> DataFrame:
    """Turns before the last ``live`` of their session, whose tool results are cleared."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return turns.withColumn("_back", back).where(F.col("_back") > live).drop("_back")


def sequence(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text", joint: str = "\n") -> DataFrame:
    """(by, place, role, text): messages as a model wants them, neighbours of one role as one."""
    w = Window.partitionBy(by).orderBy(order)
    i = turns.withColumn("_new", F.when(F.lag(role).over(w) == F.col(role), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w))
    g = i.groupBy(by, "_island").agg(F.first(role).alias("role"), F.array_sort(F.collect_list(F.struct(order, text))).alias("_all"))
    return g.select(by, F.col("_island").cast("long").alias("place"), "role", F.array_join(F.transform("_all", lambda x: x[text]), joint).alias("text"))
