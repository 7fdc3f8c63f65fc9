"""Rows of tables as documents: incremental reads and rendered bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(spark: SparkSession, table: DataFrame, watermark: str, after) -> DataFrame:
    """Rows past ``after`` by a checked identifier; the value is bound, never spliced in."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", watermark):
        raise ValueError(f"not an identifier: {watermark!r}")
    return spark.sql(f"SELECT * FROM {{src}} WHERE `{watermark}` > :after ORDER BY `{watermark}`", args={"after": after}, src=table)


def read_jdbc(spark: SparkSession, url: str, query: str, watermark: str, after, properties: dict | None = None) -> DataFrame:
    """The same over JDBC: the filter goes down to the database, rows come in fetches."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", watermark):
        raise ValueError(f"not an identifier: {watermark!r}")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").option("fetchsize", 10_000)
    return reader.options(**(properties or {})).load().where(F.col(watermark) > F.lit(after))


def row_body(labels: dict[str, str]) -> Column:
    """A headed paragraph for each column that has a value."""
    parts = (F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"## {label}\n\n"), F.col(c).cast("string"))) for c, label in labels.items())
    return F.concat_ws("\n\n", *parts)


def row_documents(table: DataFrame, key: str, labels: dict[str, str], deleted: str) -> DataFrame:
    """A document for each row with a key; a soft-deleted row is a tombstone without a body."""
    gone = F.coalesce(F.col(deleted), F.lit(False))
    return table.where(F.col(key).isNotNull()).select(key, F.when(gone, "").otherwise(row_body(labels)).alias("body"), gone.alias("is_deleted"))
