"""Consolidation of long-term memories: consent, expiry, merging, decay, pruning, profiles; and the writing of new ones.

Merging is a fold: by falling salience, a memory goes into the first kept one of its
user and kind that is like it.  Its result does not depend on one process going down
the list: a memory is kept if no more salient one that is like it is kept, and goes into
the first of those otherwise.  Users of up to ``SMALL`` memories of a kind are folded
in a task each.  Larger ones are dealt out in hashed buckets (signs of random
projections, as many tables as find a pair at the threshold with ``FOUND``), and
decided in rounds: a memory with no undecided or kept neighbour before it is kept, one
with a kept neighbour is merged, the rest waits.  A bucket tells one row for each
member, never its pairs.  Equal vectors are one member throughout.

Defined results: a memory without a vector is like nothing; null salience and hits are
0; a user without a profile has not consented; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .graph import cut
from .memory import CAP, decayed
from .pii import scan

LIKE, EPSILON, PROFILE_LEAST, TTL_DAYS = 0.9, 1e-6, 3, 365
SMALL, FOUND, BLOCK = 2048, 0.995, 512
MEMORY = "user long, id long, kind string, text string, vector array<float>, salience double, hits long, created long, last_used long, expires long, supersedes long"


def tables_for(n: int, like: float) -> tuple[int, int]:
    """(bits, tables) for groups of up to ``n``: buckets of some tens, and a pair at the threshold in one of them with ``FOUND``."""
    bits = min(16, max(4, round(math.log2(max(2, n / 32)))))
    together = (1 - math.acos(like) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - together))


def _unit(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _bucketed(members: DataFrame, bits: int, tables: int) -> DataFrame:
    """Each member in its bucket of each table."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = _unit(pdf["vector"])
            planes = np.random.default_rng(7).standard_normal((v.shape[1], bits * tables))
            sign = (v @ planes > 0).reshape(len(v), tables, bits)
            bucket = sign @ (1 << np.arange(bits))
            yield pdf.loc[pdf.index.repeat(tables)].assign(table=np.tile(np.arange(tables), len(v)), bucket=bucket.ravel())

    return members.mapInPandas(run, "user long, kind string, id long, salience double, vector array<float>, table int, bucket long")


def _near_before(pdf: pd.DataFrame, like: float) -> pd.DataFrame:
    """For each member of a bucket whether an undecided one like it comes before, and the first kept one that does."""
    pdf = pdf.sort_values(["salience", "id"], ascending=[False, True]).reset_index(drop=True)
    v, kept, n = _unit(pdf["vector"]), pdf["kept"].to_numpy(dtype=bool), len(pdf)
    waits, into = np.zeros(n, bool), np.full(n, -1)
    for at in range(0, n, BLOCK):  # the more salient ones, some at a time
        later = np.flatnonzero(~(waits & (into >= 0)))
        later = later[later > at]
        near = v[later] @ v[at : at + BLOCK].T >= like
        near &= later[:, None] > np.arange(at, min(at + BLOCK, n))
        waits[later] |= (near & ~kept[at : at + BLOCK]).any(axis=1)
        found = near & kept[at : at + BLOCK]
        new = found.any(axis=1) & (into[later] < 0)
        into[later[new]] = at + found[new].argmax(axis=1)
    has = into >= 0
    return pd.DataFrame({"user": pdf["user"], "kind": pdf["kind"], "id": pdf["id"], "waits": waits, "into": pdf["id"].to_numpy()[into], "rank": pdf["salience"].to_numpy()[into]}).assign(into=lambda d: d["into"].where(has).astype("Int64"), rank=lambda d: d["rank"].where(has))


def _rounds(members: DataFrame, most: int, like: float) -> DataFrame:
    """(user, kind, id, into) of members of large groups."""
    key = ["user", "kind", "id"]
    buckets = cut(_bucketed(members, *tables_for(most, like)))
    state = members.select(*key, F.lit(False).alias("kept"), F.lit(False).alias("merged"))
    first = F.min_by("into", F.when(F.col("into").isNotNull(), F.struct((-F.col("rank")).alias("s"), "into"))).alias("into")
    while True:
        here = buckets.join(state.where("not merged").select(*key, "kept"), key)
        told = here.groupBy("user", "kind", "table", "bucket").applyInPandas(lambda pdf: _near_before(pdf, like), "user long, kind string, id long, waits boolean, into long, rank double")
        told = cut(told.groupBy(*key).agg(F.max("waits").alias("waits"), first))
        is_kept = F.col("kept") | (~F.col("merged") & F.col("into").isNull() & ~F.coalesce("waits", F.lit(False)))
        is_merged = F.col("merged") | (~F.col("kept") & F.col("into").isNotNull())
        state = cut(state.join(told, key, "left").select(*key, is_kept.alias("kept"), is_merged.alias("merged")))
        if not state.where("not kept and not merged").limit(1).count():
            break
    # Every kept one is known now: the rest goes into the first that is like it.
    here = buckets.join(state.select(*key, "kept"), key)
    told = here.groupBy("user", "kind", "table", "bucket").applyInPandas(lambda pdf: _near_before(pdf, like), "user long, kind string, id long, waits boolean, into long, rank double")
    told = told.groupBy(*key).agg(first)
    return state.join(told, key, "left").select(*key, F.when(F.col("kept"), F.col("id")).otherwise(F.col("into")).alias("into"))


def merged_into(memories: DataFrame, like: float = LIKE, small: int = SMALL) -> DataFrame:
    """(user, id, into): the memory that each goes into, itself where it is kept; of (user, id, kind, vector, salience)."""
    m = memories.select("user", "id", "kind", F.coalesce("salience", F.lit(0.0)).alias("salience"), "vector")
    whole = m.where(F.size("vector") > 0)
    alone = m.where(~F.coalesce(F.size("vector") > 0, F.lit(False))).select("user", "id", F.col("id").alias("into"))
    # Of equal vectors the most salient stands for all: what it goes into they go into as well.
    one = F.struct((-F.col("salience")).alias("s"), "id")
    same = ["user", "kind", "vector"]
    shown = cut(whole.join(whole.groupBy(*same).agg(F.min(one)["id"].alias("rep")), same))
    reps = shown.where("id = rep").select("user", "kind", "id", "salience", "vector")
    size = reps.groupBy("user", "kind").agg(F.count(F.lit(1)).alias("size"))
    most = size.agg(F.max("size")).first()[0] or 0
    sized = reps.join(size, ["user", "kind"])
    few = sized.where(F.col("size") <= small).withColumn("hits", F.lit(0).cast("long"))
    # A small user's kinds are folded together: the fold tells them apart.
    found = folds.merge_memories(few.select("user", "id", "kind", "vector", "salience", "hits"), like).select("user", "id", "into")
    if most > small:
        found = found.union(_rounds(sized.where(F.col("size") > small).drop("size"), most, like).select("user", "id", "into"))
    back = shown.select("user", F.col("id").alias("own"), F.col("rep").alias("id")).join(found, ["user", "id"]).select("user", F.col("own").alias("id"), "into")
    return back.union(alone)


def consent(users: DataFrame, profiles: DataFrame, enabled: bool = True) -> DataFrame:
    """user and gate of each user: ``ok`` or why its memories are left alone; of profiles (user, memory_consent)."""
    p = profiles.groupBy("user").agg(F.max(F.coalesce("memory_consent", F.lit(False))).alias("yes"))
    gate = F.when(F.lit(not enabled), "disabled").when(F.col("yes").isNull(), "consent_unknown").when(~F.col("yes"), "no_consent").otherwise("ok")
    return users.select("user").distinct().join(p, "user", "left").select("user", gate.alias("gate"))


def consolidate(memories: DataFrame, profiles: DataFrame, now: int, like: float = LIKE, cap: int = CAP, small: int = SMALL) -> dict[str, DataFrame]:
    """A pass over all users: ``memories`` as they then are, a ``report`` for each user, and ``profiles`` (user, summary) of those with enough memories.

    ``memories`` is a table as ``MEMORY`` says.  Users whose gate is shut keep theirs as they are.
    """
    gates = consent(memories, profiles)
    own = memories.join(gates, "user")
    closed = own.where("gate <> 'ok'").select(*memories.columns)
    fresh = F.col("expires").isNull() | (F.col("expires") > now)
    live = cut(own.where((F.col("gate") == "ok") & fresh).select(*memories.columns).withColumn("now_salience", decayed(F.coalesce("salience", F.lit(0.0)), F.col("last_used"), now)))
    into = cut(merged_into(live.select("user", "id", "kind", "vector", F.col("now_salience").alias("salience")), like, small))
    each = live.join(into, ["user", "id"])
    # The last that went into it is the one that it supersedes.
    last = F.max_by(F.when(F.col("id") != F.col("into"), F.col("id")), F.when(F.col("id") != F.col("into"), F.struct((-F.col("now_salience")).alias("s"), "id")))
    gained = each.groupBy("user", F.col("into").alias("id")).agg(F.sum(F.coalesce("hits", F.lit(0))).alias("all_hits"), F.max(F.coalesce("salience", F.lit(0.0))).alias("top"), last.alias("gone"))
    kept = live.join(gained, ["user", "id"]).withColumn("aged", decayed(F.col("top"), F.col("last_used"), now))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("aged"), "id"))
    kept = cut(kept.withColumn("place", place))
    stay = kept.where(F.col("place") <= cap)
    new = {"salience": F.col("aged"), "hits": F.col("all_hits"), "supersedes": F.coalesce("gone", "supersedes")}
    after = stay.select(*((new[c] if c in new else F.col(c)).alias(c) for c in memories.columns))
    n = F.count(F.lit(1)).cast("long")
    # What is written is what has changed.
    changed = F.count_if(F.abs(F.col("aged") - F.col("top")) >= EPSILON).alias("decayed")
    report = gates.join(own.where((F.col("gate") == "ok") & ~fresh).groupBy("user").agg(n.alias("expired")), "user", "left").join(live.groupBy("user").agg(n.alias("scanned")), "user", "left")
    report = report.join(kept.groupBy("user").agg(n.alias("survivors"), changed, F.count_if(F.col("place") > cap).alias("pruned")), "user", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = report.select("user", F.when(F.col("gate") != "ok", F.col("gate")).alias("skipped_reason"), zero("scanned"), zero("expired"), (F.coalesce("scanned", F.lit(0)) - F.coalesce("survivors", F.lit(0))).alias("merged"), zero("decayed"), zero("pruned"), (F.coalesce("survivors", F.lit(0)) >= PROFILE_LEAST).alias("profile_refreshed"))
    return {"memories": after.unionByName(closed), "report": report, "profiles": profile_summaries(kept)}


def profile_summaries(kept: DataFrame, most: int = 20) -> DataFrame:
    """(user, summary) of users with ``PROFILE_LEAST`` memories and more: their most salient ones by kind, as a model would be shown them."""
    k = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user"))).where((F.col("n") >= PROFILE_LEAST) & (F.col("place") <= most))
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- ("), "kind", F.lit(") "), F.coalesce("text", F.lit(""))).alias("line"))))
    return k.groupBy("user").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("summary"))


def write_back(candidates: DataFrame, memories: DataFrame, profiles: DataFrame, now: int, like: float = LIKE, cap: int = CAP, ttl_days: int | None = TTL_DAYS) -> dict[str, DataFrame]:
    """``memories`` with what candidates (user, id, kind, text, vector, salience) add, and ``stored``: (user, id, supersedes) of those.

    A candidate's personal data are redacted.  One whose nearest memory of its user is
    like it takes its place, or is dropped if it says the same; a full user loses the
    least salient.
    """
    ok = consent(candidates, profiles).where("gate = 'ok'").select("user")
    c = candidates.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(ok, "user")
    clean = scan(c.select(F.col("id").alias("cid"), "text"), "cid", "text", "mask").select(F.col("id").alias("cid"), "redacted")
    c = cut(c.join(clean, c.id == clean.cid).drop("cid").withColumn("text", F.trim("redacted")))
    fresh = memories.where(F.col("expires").isNull() | (F.col("expires") > now))
    nearest = _nearest(c.select("user", "id", "vector"), fresh.select("user", F.col("id").alias("other"), F.col("vector").alias("ov"), F.col("text").alias("ot")))
    j = c.join(nearest, ["user", "id"], "left")
    close = F.coalesce(F.col("sim") >= like, F.lit(False))
    new = cut(j.where(~(close & (F.lower(F.trim("ot")) == F.lower("text")))).withColumn("supersedes", F.when(close, F.col("other"))))
    expires = F.lit(None).cast("long") if ttl_days is None else F.lit(now + ttl_days * 86_400).cast("long")
    value = {"salience": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("salience", F.lit(0.0)))), "hits": F.lit(0).cast("long"), "created": F.lit(now).cast("long"), "last_used": F.lit(now).cast("long"), "expires": expires}
    added = new.select(*((value[x] if x in value else F.col(x)).alias(x) for x in memories.columns))
    gone = new.where("supersedes IS NOT NULL").select("user", F.col("supersedes").alias("id")).distinct()
    all_ = memories.join(gone, ["user", "id"], "left_anti").select(*memories.columns).unionByName(added)
    touched = added.select("user").distinct().withColumn("full", F.lit(True))
    place = F.row_number().over(Window.partitionBy("user").orderBy(decayed(F.coalesce("salience", F.lit(0.0)), F.col("last_used"), now).desc(), "id"))
    pruned = all_.join(touched, "user", "left").withColumn("place", place).where(F.col("full").isNull() | (F.col("place") <= cap))
    return {"memories": pruned.select(*memories.columns), "stored": new.select("user", "id", "supersedes")}


def _nearest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(user, id, other, sim, ot): of each asked vector the most like held one of its user, the lesser id on a tie."""
    from .search import best_in_group

    best = best_in_group(asked.select(F.col("id").alias("query"), F.col("user").alias("grp"), "vector"), held.select(F.col("other").alias("id"), F.col("user").alias("grp"), F.col("ov").alias("vector")), itself=True)
    best = best.select(F.col("grp").alias("user"), F.col("query").alias("id"), F.col("id").alias("other"), F.col("score").alias("sim"))
    return best.join(held.select("user", "other", "ot"), ["user", "other"]).select("user", "id", "other", "sim", "ot")
