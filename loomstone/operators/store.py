"""Keyed tables: deletions, rewrites, additions and lookups, each giving the new snapshot or a listing of it.

A deletion keeps the row and marks it (``is_deleted``) unless it is a hard one.  Keys to
act on are tables, so that what is deleted can be as large as what stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def _keys(on: Keys) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def soft_delete(rows: DataFrame, gone: DataFrame, on: Keys) -> DataFrame:
    """Rows with ``is_deleted``: those of the given keys, and those that were."""
    marked = gone.select(*_keys(on)).distinct().withColumn("_gone", F.lit(True))
    was = F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in rows.columns else F.lit(False)
    return rows.join(marked, _keys(on), "left").withColumn("is_deleted", was | F.coalesce("_gone", F.lit(False))).drop("_gone")


def soft_delete_where(rows: DataFrame, gone: Column) -> DataFrame:
    """The same by a condition; a row for which it is null stays as it is."""
    was = F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in rows.columns else F.lit(False)
    return rows.withColumn("is_deleted", was | F.coalesce(gone, F.lit(False)))


def hard_delete_where(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows but for those that a condition names; one for which it is null stays."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def prune(rows: DataFrame, gone: DataFrame, on: Keys) -> DataFrame:
    """Rows without those of the given keys."""
    return rows.join(gone.select(*_keys(on)), _keys(on), "left_anti")


def rewrite(rows: DataFrame, new: DataFrame, on: Keys) -> DataFrame:
    """Rows with the columns that ``new`` has beside the keys, where it has a row for them; of several rows of a key the greatest."""
    columns = [c for c in new.columns if c not in _keys(on)]
    one = new.groupBy(*_keys(on)).agg(F.max(F.struct(*columns)).alias("_new"))
    j = rows.join(one, _keys(on), "left")
    return j.select(*(F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def missing(rows: DataFrame, kept: DataFrame, on: Keys) -> DataFrame:
    """The keys of rows that are not among those kept, each once."""
    return rows.select(*_keys(on)).distinct().join(kept.select(*_keys(on)), _keys(on), "left_anti")


def counts(rows: DataFrame, where: Column, by: Keys) -> DataFrame:
    """Rows of each group for which a condition holds; groups without one are not told."""
    return rows.where(where).groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("n"))


def get_or_create(have: DataFrame, asked: DataFrame, on: Keys) -> DataFrame:
    """The keys that are there and those that are asked for, each once, with ``created``."""
    old = have.select(*_keys(on)).distinct()
    new = asked.select(*_keys(on)).distinct().join(old, _keys(on), "left_anti")
    return old.withColumn("created", F.lit(False)).union(new.withColumn("created", F.lit(True)))


def append(rows: DataFrame, by: str, order: str, **values: Column) -> DataFrame:
    """Rows and one more of each group, next in order, with the values given; other columns are null."""
    last = rows.groupBy(by).agg((F.max(order) + 1).alias(order))
    return rows.unionByName(last.select(by, order, *(v.alias(k) for k, v in values.items())), allowMissingColumns=True)


def newest(rows: DataFrame, by: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in an order: a top-n listing."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def listed(rows: DataFrame, by: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows with their place in their group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def next_versions(rows: DataFrame, held: DataFrame, on: Keys, sha: str = "sha", held_sha: str = "m_sha", held_version: str = "m_version") -> DataFrame:
    """Rows with ``version``: the held one, one more where both have content and it differs, 1 for a new row."""
    j = rows.join(held, _keys(on), "left")
    changed = F.coalesce(F.col(sha) != F.col(held_sha), F.lit(False))
    return j.withColumn("version", F.coalesce(held_version, F.lit(1)) + F.when(changed, 1).otherwise(0))
