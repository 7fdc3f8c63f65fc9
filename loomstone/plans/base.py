"""Registration of queries, and the model's tables derived from the given ones.

Derivations are plain arithmetic on ids, so that SQL can repeat them: see
``CORPUS_SQL`` beside ``corpus``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple] = {}
#: The module of each query.
FAMILY: dict[str, str] = {}
#: Fixed: document types by falling authority, with the authority of each.
DOC_TYPES = {"policy": 100, "standard": 90, "contract": 85, "handbook": 70, "runbook": 60, "faq": 40, "email": 20, "note": 10}
CLASSES = ("public", "internal", "confidential", "restricted")
#: (persona, tenant, user, roles, groups, highest rank)
PERSONAS = [
    ("admin", "src0", "u1", ["admin", "user"], ["g1", "g2"], 3),
    ("engineer", "src0", "u2", ["user"], ["g1"], 2),
    ("intern", "src0", "u3", ["user"], ["g4"], 0),
    ("analyst", "src1", "u1", ["user", "auditor"], ["g3"], 2),
]
NOW = 1_735_689_600  # 2025-01-01, the time of every query that needs one


#: Text bytes of one Arrow batch: a worker holds what it makes of a batch, which is many times that.
BATCH_BYTES = 2 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep Arrow batches small unless a limit is set."""
    if spark.conf.get(BATCH_LIMIT, "64m") in ("64m", "67108864b"):
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)


def query(name: str, sql: str | None = None):
    """Registers a function of (tables) as the query ``name``; ``sql`` is the same in DuckDB's dialect."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = (run, sql)
        FAMILY[name] = fn.__module__.rpartition(".")[2]
        return fn

    return register


def strings(*values: str):
    return F.array(*map(F.lit, values)).cast("array<string>")


class Tables:
    """The tables of a folder, read when asked for, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def corpus(self) -> DataFrame:
        """Documents with tenant, type, classification, access lists, deletion and times."""
        i = F.col("doc_id")
        none = strings()
        types = F.array(*map(F.lit, DOC_TYPES))
        return self.documents.select(
            "doc_id", "text", "lang", "n_chars",
            F.col("source").alias("tenant_id"),
            F.element_at(types, (i % 8 + 1).cast("int")).alias("doc_type"),
            (i % 4).cast("int").alias("classification_rank"),
            F.when(i % 3 == 0, none).otherwise(F.array(F.concat(F.lit("g"), (i % 5).cast("string")))).alias("allowed_groups"),
            F.when(i % 7 == 0, strings("auditor")).otherwise(none).alias("allowed_roles"),
            F.when(i % 10 == 0, F.array(F.lit("u1"), F.concat(F.lit("u"), (i % 3).cast("string")))).otherwise(none).alias("allowed_users"),
            F.when(i % 11 == 0, strings("u2")).otherwise(none).alias("denied_users"),
            (i % 17 == 0).alias("is_deleted"),
            (F.lit(1_704_067_200) + i * 3600).alias("modified"),
        )

    @property
    def principals(self) -> DataFrame:
        return self.spark.createDataFrame(PERSONAS, "persona string, tenant string, user string, roles array<string>, groups array<string>, clearance int")

    def values(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


CORPUS_SQL = f"""corpus AS (SELECT doc_id, text, lang, n_chars, source AS tenant_id,
  ({sql_list(DOC_TYPES)})[doc_id % 8 + 1] AS doc_type, doc_id % 4 AS classification_rank,
  CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE ['g' || (doc_id % 5)] END AS allowed_groups,
  CASE WHEN doc_id % 7 = 0 THEN ['auditor'] ELSE []::VARCHAR[] END AS allowed_roles,
  CASE WHEN doc_id % 10 = 0 THEN ['u1', 'u' || (doc_id % 3)] ELSE []::VARCHAR[] END AS allowed_users,
  CASE WHEN doc_id % 11 = 0 THEN ['u2'] ELSE []::VARCHAR[] END AS denied_users,
  doc_id % 17 = 0 AS is_deleted, 1704067200 + doc_id * 3600 AS modified FROM documents)"""
PRINCIPALS_SQL = "principals(persona, tenant, usr, roles, grps, clearance) AS (VALUES " + ", ".join(f"('{p}', '{t}', '{u}', {sql_list(r)}, {sql_list(g)}, {c})" for p, t, u, r, g, c in PERSONAS) + ")"
