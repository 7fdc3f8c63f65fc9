"""Keyed tables: marks stay, nulls leave rows as they are, keys may repeat."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import store as S


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", "x", True), (2, "a", None, False), (3, "b", "y", None), (None, "c", "z", False)], "id long, grp string, v string, is_deleted boolean").cache()


def flags(df):
    return {r.id: r.is_deleted for r in df.collect()}


def test_soft_deletion(spark, rows):
    gone = spark.createDataFrame([(2,), (2,), (9,), (None,)], "id long")
    assert flags(S.soft_delete(rows, gone, "id")) == {1: True, 2: True, 3: False, None: False}
    assert flags(S.soft_delete_where(rows, F.col("v") == "y")) == {1: True, 2: False, 3: True, None: False}
    assert S.soft_delete(rows, gone, "id").columns == rows.columns and S.soft_delete(rows, gone, "id").count() == 4


def test_hard_deletion(spark, rows):
    assert {r.id for r in S.hard_delete_where(rows, F.col("v") == "x").collect()} == {2, 3, None}
    assert {r.id for r in S.prune(rows, spark.createDataFrame([(1,), (1,)], "id long"), "id").collect()} == {2, 3, None}


def test_rewrite(spark, rows):
    new = spark.createDataFrame([("a", "p"), ("a", "q"), ("c", None)], "grp string, v string")
    assert {(r.id, r.v) for r in S.rewrite(rows, new, "grp").collect()} == {(1, "q"), (2, "q"), (3, "y"), (None, "z")}


def test_keys(spark, rows):
    asked = spark.createDataFrame([("b",), ("d",), ("d",)], "grp string")
    assert {tuple(r) for r in S.get_or_create(rows, asked, "grp").collect()} == {("a", False), ("b", False), ("c", False), ("d", True)}
    assert {r.grp for r in S.missing(rows, asked, "grp").collect()} == {"a", "c"}
    assert {tuple(r) for r in S.counts(rows, F.col("v").isNotNull(), "grp").collect()} == {("a", 1), ("b", 1), ("c", 1)}


def test_order(spark):
    turns = spark.createDataFrame([(1, 0, "x"), (1, 4, "y"), (2, 7, "z")], "conv long, turn long, text string")
    assert {(r.conv, r.turn, r.text) for r in S.append(turns, "conv", "turn").collect()} == {(1, 0, "x"), (1, 4, "y"), (2, 7, "z"), (1, 5, None), (2, 8, None)}
    assert {(r.conv, r.turn) for r in S.newest(turns, "conv", (F.desc("turn"),), 1).collect()} == {(1, 4), (2, 7)}
    assert {(r.turn, r.place) for r in S.listed(turns, "conv", ("turn",)).collect()} == {(0, 1), (4, 2), (7, 1)}


def test_versions(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "x")], "id long, sha string")
    held = spark.createDataFrame([(1, "a", 3), (2, "c", 4), (3, "d", 5)], "id long, m_sha string, m_version long")
    assert {(r.id, r.version) for r in S.next_versions(new, held, "id").collect()} == {(1, 3), (2, 5), (3, 5), (4, 1)}
