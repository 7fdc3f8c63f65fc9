"""Incremental change: what a listing asks for against a manifest, and keyed tables rewritten as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(listing: DataFrame, manifest: DataFrame, key: str = "document_id", force: bool = False) -> DataFrame:
    """Each listed document with action, reason and next version, by ordered rules.

    listing: key, sha, etag, acl, deleted; manifest: key, m_sha, m_etag, m_acl, m_version, m_deleted.
    """
    j = listing.join(manifest, key, "left")
    known, moved = F.col("m_version").isNotNull(), ~F.col("etag").eqNullSafe(F.col("m_etag"))
    acl = ~F.col("acl").eqNullSafe(F.col("m_acl"))
    rules = [
        (F.col("deleted") & known, "delete", "deleted at source"),
        (F.col("deleted"), "skip", "deleted and unknown"),
        (~known, "create", "new"),
        (F.lit(force), "update", "forced"),
        (F.col("m_deleted"), "create", "reappeared"),
        (F.col("sha").isNull() & moved, "update", "etag moved"),
        (F.col("sha").isNull() & acl, "acl_only", "access changed"),
        (F.col("sha").isNull(), "skip", "unchanged"),
        (~F.col("sha").eqNullSafe(F.col("m_sha")), "update", "content changed"),
        (acl, "acl_only", "access changed"),
        (moved, "skip", "touched"),
    ]
    action, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, a, r in rules[1:]:
        action, reason = action.when(condition, a), reason.when(condition, r)
    j = j.withColumn("action", action.otherwise("skip")).withColumn("reason", reason.otherwise("unchanged"))
    return j.withColumn("version", next_version(F.col("action"), F.col("m_version")))


def next_version(action: Column, version: Column) -> Column:
    now = F.greatest(F.coalesce(version, F.lit(1)), F.lit(1))
    return F.when(action == "update", now + 1).otherwise(now).cast("long")


def deletions(manifest: DataFrame, listing: DataFrame, key: str = "document_id", full_scan: bool = True) -> DataFrame:
    """Live manifest entries that a full scan did not see; a partial scan deletes nothing."""
    live = manifest.where("not m_deleted")
    return live.join(listing, key, "left_anti").where(F.lit(full_scan)).select(key)


def merge_newest(mine: DataFrame, latest: DataFrame, key: str, seen: str) -> DataFrame:
    """One row a key: the newer by ``seen``, mine on a tie."""
    both = mine.withColumn("_mine", F.lit(1)).unionByName(latest.withColumn("_mine", F.lit(0)))
    rest = [c for c in both.columns if c not in (key, "_mine")]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(seen, "_mine")).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """A new snapshot: what is not replaced, and the new rows."""
    return old.join(new.select(*([key] if isinstance(key, str) else key)), key, "left_anti").unionByName(new)


def single_tenant(batch: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """The batch; it fails when run if its rows are of more than one tenant."""
    n = batch.agg(F.count_distinct(tenant).alias("n"))
    return batch.crossJoin(F.broadcast(n.select(F.assert_true(F.col("n") <= 1, F.lit("a batch of several tenants")).alias("_ok")))).drop("_ok")


def run_status(failed: Column, done: Column) -> Column:
    return F.when(failed == 0, "succeeded").when(done > 0, "partial").otherwise("failed")


def within_hours(ts: Column, start: int, end: int, zone: str = "UTC", days: tuple[int, ...] = (2, 3, 4, 5, 6)) -> Column:
    """Whether a time is in working hours, which may pass midnight, on a working day (1 is Sunday)."""
    local = F.from_utc_timestamp(ts, zone)
    hour = F.hour(local)
    inside = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
    return F.dayofweek(local).isin(*days) & inside
