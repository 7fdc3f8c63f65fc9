"""Queries of ingestion runs: one listing through classification, fetch, second classification and all tables of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators.graph import new_folder
from ..sources import versions as V
from .base import query

_PLAN_SQL = """WITH l AS (SELECT source, doc_id AS document_id, CASE WHEN doc_id % 19 <> 0 THEN sha256(text) END AS sha, 'e' || (doc_id % 6) AS etag, 'a' || (doc_id % 5) AS acl, doc_id % 23 = 0 AS deleted FROM documents WHERE doc_id % 29 <> 0),
m AS (SELECT source, doc_id AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS m_sha, CASE WHEN doc_id % 4 = 0 THEN 'e9' ELSE 'e' || (doc_id % 6) END AS m_etag, CASE WHEN doc_id % 5 = 0 THEN 'a9' ELSE 'a' || (doc_id % 5) END AS m_acl, 1 + doc_id % 3 AS m_version, doc_id % 31 = 0 AS m_deleted FROM documents WHERE doc_id % 13 <> 0),
t AS (SELECT source, doc_id AS document_id, sha256(text) AS real, strlen(text) AS bytes FROM documents WHERE doc_id % 37 <> 0),
c AS (SELECT *, CASE WHEN deleted AND m_version IS NOT NULL THEN 'delete' WHEN deleted THEN 'skip' WHEN m_version IS NULL OR m_deleted THEN 'create' WHEN sha IS NULL AND etag <> m_etag THEN 'update' WHEN sha IS NULL AND acl <> m_acl THEN 'acl_only' WHEN sha IS NULL THEN 'skip' WHEN sha <> m_sha THEN 'update' WHEN acl <> m_acl THEN 'acl_only' ELSE 'skip' END AS action FROM l LEFT JOIN m USING (source, document_id)),
g AS (SELECT source, document_id, m_version, m_sha, 'delete' AS action FROM m ANTI JOIN l USING (source, document_id) WHERE NOT m_deleted),
j AS (SELECT *, action IN ('create', 'update') AS wanted, coalesce(real = m_sha AND NOT m_deleted, false) AS same FROM c LEFT JOIN t USING (source, document_id)),
f AS (SELECT source, document_id, m_version, CASE WHEN wanted AND real IS NULL THEN 'fail' WHEN wanted AND bytes > 20000 THEN 'skip' WHEN wanted AND same AND acl IS DISTINCT FROM m_acl THEN 'acl_only' WHEN wanted AND same THEN 'skip' ELSE action END AS final FROM j UNION ALL SELECT source, document_id, m_version, 'delete' FROM g)"""


def listing(t):
    i = F.col("doc_id")
    return t.documents.where(i % 29 != 0).select("source", i.alias("document_id"), F.when(i % 19 != 0, F.sha2("text", 256)).alias("sha"), F.concat(F.lit("e"), (i % 6).cast("string")).alias("etag"), F.concat(F.lit("a"), (i % 5).cast("string")).alias("acl"), (i % 23 == 0).alias("deleted"))


def entries(t):
    i = F.col("doc_id")
    return t.documents.where(i % 13 != 0).select(
        "source", i.alias("document_id"), F.when(i % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("sha"), F.when(i % 4 == 0, "e9").otherwise(F.concat(F.lit("e"), (i % 6).cast("string"))).alias("etag"),
        F.when(i % 5 == 0, "a9").otherwise(F.concat(F.lit("a"), (i % 5).cast("string"))).alias("acl"), (1 + i % 3).alias("version"), F.lit(1).cast("long").alias("chunks"), (i % 31 == 0).alias("is_deleted"), i.alias("seen"),
    )


def contents(t):
    return t.documents.where("doc_id % 37 <> 0").select("source", F.col("doc_id").alias("document_id"), "text")


@query("process_doc", f"{_PLAN_SQL} SELECT source, document_id, final, (greatest(coalesce(m_version, 1), 1) + CASE WHEN final = 'update' THEN 1 ELSE 0 END)::BIGINT AS version FROM f")
def process_doc(t):
    """What becomes of each document once its content is there."""
    p = I.plan(listing(t), entries(t), full_scan=True)
    return I.judged(p, contents(t), most_bytes=20_000).select("source", "document_id", "final", F.col("version").cast("long").alias("version"))


_COUNTS = {"created": "create", "updated": "update", "acl_only": "acl_only", "deleted": "delete", "skipped": "skip", "failed": "fail"}


@query("run_ingest", f"{_PLAN_SQL} SELECT source, {', '.join(f'''count(*) FILTER (WHERE final = '{a}') AS {n}''' for n, a in _COUNTS.items())}, CASE WHEN count(*) FILTER (WHERE final = 'fail') = 0 THEN 'succeeded' WHEN count(*) FILTER (WHERE final <> 'fail') > 0 THEN 'partial' ELSE 'failed' END AS status FROM f GROUP BY source")
def run_ingest(t):
    """A run over all sources into an index of its own; the rows are read back from its table of runs."""
    index = I.Index(t.spark, new_folder(t.spark, "index"))
    index.write("manifest", lambda old: entries(t), "before")
    return I.run_ingest(index, listing(t), contents(t), "run", 1 << 40, full_scan=True, most_bytes=20_000).select("source", *_COUNTS, "status")


@query("manifest_store_local", "SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 1 OR doc_id % 10 = 4 THEN 'two' ELSE 'one' END AS acl, CASE WHEN doc_id % 2 = 1 OR doc_id % 10 = 4 THEN 2 ELSE 1 END::BIGINT AS version FROM documents WHERE doc_id % 6 <> 1 OR doc_id % 2 = 1")
def manifest_store_local(t):
    """Two saves of one manifest, the second from what the first writer did not know, read back from its current version."""

    def rows(d, acl, version, seen):
        return d.select(F.col("doc_id").alias("document_id"), F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.md5("text").alias("sha"), F.lit("e").alias("etag"), F.lit(acl).alias("acl"), F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("chunks"), F.lit(False).alias("is_deleted"), seen.cast("long").alias("seen"))

    i = F.col("doc_id")
    table = V.manifest(t.spark, new_folder(t.spark, "manifests"), "t", "s")
    V.save_manifest(table, rows(t.documents.where(i % 6 != 1), "one", 1, F.lit(10)))
    V.save_manifest(table, rows(t.documents.where((i % 2 == 1) | (i % 10 == 4) | (i % 10 == 6)), "two", 2, F.when(i % 10 == 6, 9).otherwise(10)))
    return V.load_manifest(table, "t", "s").select("document_id", "acl", "version")
