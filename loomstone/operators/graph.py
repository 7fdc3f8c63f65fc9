"""Cutting lineage in the shared folder, spreading small inputs, and classes of nodes that edges join."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one in local mode, as in tests, and else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="loomstone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and read from there, so that loops don't build on all they did."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files make fewer tasks than there are; large inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster) of all nodes (id): the least id that edges (a, b), taken both ways, lead to.

    Every pass gives each node the least label among its neighbours, then the label of
    that label, so long chains shrink by doubling; passes go on until no label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("cluster")))
    while True:
        near = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        low = labels.join(near, "id", "left").select("id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("other", "cluster")).alias("cluster"))
        jump = low.select(F.col("id").alias("cluster"), F.col("cluster").alias("further"))
        new = cut(low.join(jump, "cluster", "left").select("id", "old", F.coalesce("further", "cluster").alias("cluster")))
        labels = new.select("id", "cluster")
        if not new.where("old <> cluster").limit(1).count():
            return labels
