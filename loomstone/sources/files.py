"""Files of a folder or store, through Spark's readers alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*", since: str | None = None) -> DataFrame:
    """uri, name, size, modified and etag of files; their contents are not read unless asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if since:
        reader = reader.option("modifiedAfter", since)
    f = reader.load(folder)
    etag = F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return f.select(F.col("path").alias("uri"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), etag.alias("etag"), "content").where(~F.col("name").endswith(".acl.json"))


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """uri and text of whole files."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
