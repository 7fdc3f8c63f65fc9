"""Assembly of prompts: what of sources, memories and turns goes into each question's window, under one budget.

Parts are taken in a fixed order: what every prompt has, pinned turns and the last
few, the summary, memory lines in order up to their share, sources by value for each
token up to theirs, then older turns from the newest as far as they fit.  If what
cannot be left out is too much already, ``context.shed`` takes away the least valuable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .context import shed
from .graph import cut

#: Fixed: a window and what of it is kept free for the answer, shares of sources and memories, turns that stay.
WINDOW, RESERVED, SOURCES, MEMORIES, LIVE = 120_000, 16_000, 0.55, 0.08, 4
ITEM = ["grp", "kind", "id", "value", "pos", "tokens", "pinned"]


def budgets(asked: DataFrame, window: int = WINDOW, reserved: int = RESERVED) -> DataFrame:
    """grp, room (tokens of a prompt), for_sources and for_memories."""
    room = F.lit(window - reserved)
    return asked.select("grp", room.alias("room"), F.floor(room * SOURCES).cast("long").alias("for_sources"), F.floor(room * MEMORIES).cast("long").alias("for_memories"))


def _packed(sources: DataFrame, room: int) -> DataFrame:
    """Sources with ``dropped_reason``: by falling value for each token, each if it still fits; one without tokens or value is left out."""
    s = sources.withColumn("density", F.round(F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0))) / F.greatest(F.lit(1), "tokens"), 9))
    worth = F.col("density") > 0
    kept = folds.pack_context(s.where(worth), room)
    return s.join(kept, ["grp", "id"], "left").withColumn("dropped_reason", F.when(~worth, "no_value").otherwise(F.col("dropped_reason"))).drop("density")


def _lines(memories: DataFrame, room: int) -> DataFrame:
    """Memory lines in order, with ``dropped_reason`` from the first that does not fit."""
    total = F.sum("tokens").over(Window.partitionBy("grp").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0))
    return memories.withColumn("dropped_reason", F.when(total > room, "memory_budget"))


def assemble(asked: DataFrame, turns: DataFrame, sources: DataFrame, memories: DataFrame, window: int = WINDOW, reserved: int = RESERVED, live: int = LIVE) -> dict[str, DataFrame]:
    """``items`` (grp, kind, id, tokens, dropped_reason: null if it is in the prompt) and ``stats`` (grp, tokens, room, utilisation, and what of each kind is in and out).

    asked: (grp long, fixed, summary) tokens of what each prompt has and of its summary;
    turns: (grp, id, tokens, pinned), sources: (grp, id, tokens, value), memories: (grp, id, pos, tokens).
    """
    room = window - reserved
    none = F.lit(None)
    s = _packed(sources.select("grp", F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"), F.col("tokens").cast("long").alias("tokens")), int(room * SOURCES))
    m = _lines(memories.select("grp", F.col("id").cast("long").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("tokens").cast("long").alias("tokens")), int(room * MEMORIES))
    used = s.where("dropped_reason IS NULL").select("grp", "tokens").union(m.where("dropped_reason IS NULL").select("grp", "tokens")).union(asked.select("grp", (F.col("fixed") + F.coalesce("summary", F.lit(0))).cast("long")))
    left = asked.select("grp").join(used.groupBy("grp").agg(F.sum("tokens").alias("used")), "grp", "left").select("grp", (F.lit(room) - F.coalesce("used", F.lit(0))).alias("left"))
    # History: pinned turns and the last few always, then from the newest what fits.
    t = turns.select("grp", F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    back = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("id")))
    t = t.join(left, "grp").withColumn("must", F.col("pinned") | (back <= live))
    kept = _history(t)
    t = t.join(kept.withColumn("taken", F.lit(True)), ["grp", "id"], "left").withColumn("dropped_reason", F.when(F.col("taken").isNull(), "history_budget"))
    items = (
        s.select("grp", F.lit("source").alias("kind"), "id", "value", F.col("id").alias("pos"), "tokens", F.lit(False).alias("pinned"), "dropped_reason")
        .union(m.select("grp", F.lit("memory"), "id", none.cast("double"), "pos", "tokens", F.lit(False), "dropped_reason"))
        .union(t.select("grp", F.lit("turn"), "id", none.cast("double"), "id", "tokens", "pinned", "dropped_reason"))
        .union(asked.where("summary > 0").select("grp", F.lit("summary"), F.lit(0).cast("long"), none.cast("double"), F.lit(0).cast("long"), F.col("summary").cast("long"), F.lit(False), none.cast("string")))
    )
    items = cut(items)  # all that follows starts from what has been taken
    inside = items.where("dropped_reason IS NULL")
    size = inside.groupBy("grp").agg(F.sum("tokens").alias("size"))
    need = asked.join(size, "grp", "left").select("grp", (F.col("fixed") + F.coalesce("size", F.lit(0)) - room).alias("need"))
    gone = shed(inside.select(*ITEM), need).where("shed").select("grp", "kind", "id", F.lit("shed").alias("shed"))
    items = items.join(gone, ["grp", "kind", "id"], "left").select("grp", "kind", "id", "tokens", F.coalesce("dropped_reason", "shed").alias("dropped_reason"))
    stays = F.col("dropped_reason").isNull()
    count = lambda kind, ok: F.count_if((F.col("kind") == kind) & ok)
    g = items.groupBy("grp").agg(F.sum(F.when(stays, F.col("tokens")).otherwise(0)).alias("in_items"), *(count(k, stays).alias(f"{k}s") for k in ("source", "memory", "turn")), *(count(k, ~stays).alias(f"{k}s_dropped") for k in ("source", "memory", "turn")))
    counts = [c for c in g.columns if c not in ("grp", "in_items")]
    tokens = (F.col("fixed") + F.coalesce("in_items", F.lit(0))).cast("long")
    stats = asked.join(g, "grp", "left").select("grp", tokens.alias("tokens"), F.lit(room).cast("long").alias("room"), F.round(tokens / room, 6).alias("utilisation"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    return {"items": items, "stats": stats}


def _history(turns: DataFrame) -> DataFrame:
    """(grp, id) of the turns that are taken, from the newest: one that does not fit leaves room for older ones."""

    def step(room, row):
        grp, i, n, must, left, always = row
        room = left - always if room is None else room
        if must:
            return room, (grp, i)
        return (room - n, (grp, i)) if n <= room else (room, None)

    always = F.sum(F.when(F.col("must"), F.col("tokens")).otherwise(0)).over(Window.partitionBy("grp"))
    t = turns.select("grp", "id", "tokens", "must", "left", always.alias("always"))
    return folds.in_order(t, "grp", [F.desc("id")], step, "grp long, id long")
