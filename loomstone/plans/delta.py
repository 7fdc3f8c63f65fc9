"""Queries of incremental change over a listing and a manifest derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta as D
from ..operators import store as S
from .base import query

LISTING_SQL = """listing AS (SELECT doc_id AS document_id, source, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE md5(text) END AS sha, 'e' || (doc_id % 6) AS etag, 'a' || (doc_id % 5) AS acl, doc_id % 23 = 0 AS deleted, n_chars FROM documents WHERE doc_id % 29 <> 0),
manifest AS (SELECT doc_id AS document_id, source AS m_source, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS m_sha, CASE WHEN doc_id % 4 = 0 THEN 'e9' ELSE 'e' || (doc_id % 6) END AS m_etag, CASE WHEN doc_id % 5 = 0 THEN 'a9' ELSE 'a' || (doc_id % 5) END AS m_acl, doc_id % 3 AS m_version, doc_id % 31 = 0 AS m_deleted, doc_id * 10 AS m_seen FROM documents WHERE doc_id % 13 <> 0)"""
CLASSIFY_SQL = f"""WITH {LISTING_SQL}, j AS (SELECT l.*, m.* EXCLUDE (document_id) FROM listing l LEFT JOIN manifest m USING (document_id)),
c AS (SELECT *, CASE WHEN deleted AND m_version IS NOT NULL THEN 'delete' WHEN deleted THEN 'skip' WHEN m_version IS NULL THEN 'create' WHEN m_deleted THEN 'create' WHEN sha IS NULL AND etag IS DISTINCT FROM m_etag THEN 'update'
 WHEN sha IS NULL AND acl IS DISTINCT FROM m_acl THEN 'acl_only' WHEN sha IS NULL THEN 'skip' WHEN sha <> m_sha THEN 'update' WHEN acl <> m_acl THEN 'acl_only' ELSE 'skip' END AS action,
 CASE WHEN deleted AND m_version IS NOT NULL THEN 'deleted at source' WHEN deleted THEN 'deleted and unknown' WHEN m_version IS NULL THEN 'new' WHEN m_deleted THEN 'reappeared' WHEN sha IS NULL AND etag IS DISTINCT FROM m_etag THEN 'etag moved'
 WHEN sha IS NULL AND acl IS DISTINCT FROM m_acl THEN 'access changed' WHEN sha IS NULL THEN 'unchanged' WHEN sha <> m_sha THEN 'content changed' WHEN acl <> m_acl THEN 'access changed' WHEN etag <> m_etag THEN 'touched' ELSE 'unchanged' END AS reason FROM j),
decided AS (SELECT *, greatest(coalesce(m_version, 1), 1) + CASE WHEN action = 'update' THEN 1 ELSE 0 END AS version FROM c)"""


def listing(t):
    i = F.col("doc_id")
    return t.documents.where(i % 29 != 0).select(
        i.alias("document_id"), "source", F.when(i % 19 != 0, F.md5("text")).alias("sha"), F.concat(F.lit("e"), (i % 6).cast("string")).alias("etag"),
        F.concat(F.lit("a"), (i % 5).cast("string")).alias("acl"), (i % 23 == 0).alias("deleted"), "n_chars",
    )


def manifest(t):
    i = F.col("doc_id")
    return t.documents.where(i % 13 != 0).select(
        i.alias("document_id"), F.col("source").alias("m_source"), F.when(i % 7 == 0, "old").otherwise(F.md5("text")).alias("m_sha"), F.when(i % 4 == 0, "e9").otherwise(F.concat(F.lit("e"), (i % 6).cast("string"))).alias("m_etag"),
        F.when(i % 5 == 0, "a9").otherwise(F.concat(F.lit("a"), (i % 5).cast("string"))).alias("m_acl"), (i % 3).alias("m_version"), (i % 31 == 0).alias("m_deleted"), (i * 10).alias("m_seen"),
    )


def decided(t):
    return D.classify(listing(t), manifest(t))


@query("delta_classify", f"{CLASSIFY_SQL} SELECT document_id, action, reason FROM decided")
def delta_classify(t):
    return decided(t).select("document_id", "action", "reason")


@query("delta_entry_rule", f"{CLASSIFY_SQL} SELECT document_id, action FROM decided WHERE m_version IS NOT NULL AND NOT deleted AND NOT m_deleted AND sha IS NULL")
def delta_entry_rule(t):
    return decided(t).where("m_version is not null and not deleted and not m_deleted and sha is null").select("document_id", "action")


@query("delta_version", f"{CLASSIFY_SQL} SELECT document_id, version FROM decided")
def delta_version(t):
    return decided(t).select("document_id", "version")


@query("delta_deletions", f"WITH {LISTING_SQL} SELECT document_id FROM manifest ANTI JOIN listing USING (document_id) WHERE NOT m_deleted")
def delta_deletions(t):
    return D.deletions(manifest(t), listing(t))


@query("delta_counts", f"{CLASSIFY_SQL}, gone AS (SELECT count(*) AS n FROM manifest ANTI JOIN listing USING (document_id) WHERE NOT m_deleted) SELECT action, count(*) AS n FROM decided GROUP BY action UNION ALL SELECT 'vanished', n FROM gone")
def delta_counts(t):
    gone = D.deletions(manifest(t), listing(t)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("vanished").alias("action"), "n")
    return decided(t).groupBy("action").agg(F.count(F.lit(1)).alias("n")).union(gone)


@query("src_fetch_cond", f"WITH {LISTING_SQL} SELECT document_id FROM listing ANTI JOIN (SELECT document_id, m_etag AS etag FROM manifest) USING (document_id, etag)")
def src_fetch_cond(t):
    return listing(t).join(manifest(t).select("document_id", F.col("m_etag").alias("etag")), ["document_id", "etag"], "left_anti").select("document_id")


@query("delta_prime", f"WITH {LISTING_SQL} SELECT document_id, m_etag AS known_etag FROM listing LEFT JOIN manifest USING (document_id)")
def delta_prime(t):
    return listing(t).join(manifest(t), "document_id", "left").select("document_id", F.col("m_etag").alias("known_etag"))


@query("manifest_merge", f"WITH {LISTING_SQL}, latest AS (SELECT document_id, 'theirs' AS owner, m_seen + (document_id % 3) - 1 AS seen FROM manifest WHERE document_id % 2 = 0), mine AS (SELECT document_id, 'mine' AS owner, m_seen AS seen FROM manifest WHERE document_id % 3 <> 0) SELECT document_id, CASE WHEN l.document_id IS NULL OR m.seen >= l.seen THEN m.owner ELSE l.owner END AS owner, greatest(m.seen, l.seen) AS seen FROM mine m FULL JOIN latest l USING (document_id)".replace("CASE WHEN l.document_id IS NULL OR m.seen >= l.seen", "CASE WHEN l.seen IS NULL OR m.seen >= l.seen"))
def manifest_merge(t):
    m, i = manifest(t), F.col("document_id")
    latest = m.where(i % 2 == 0).select(i, F.lit("theirs").alias("owner"), (F.col("m_seen") + i % 3 - 1).alias("seen"))
    mine = m.where(i % 3 != 0).select(i, F.lit("mine").alias("owner"), F.col("m_seen").alias("seen"))
    return D.merge_newest(mine, latest, "document_id", "seen")


@query("manifest_entry", f"{CLASSIFY_SQL} SELECT document_id, coalesce(sha, m_sha) AS sha, etag, acl, version, deleted AS is_deleted, 'run1' AS last_run_id FROM decided")
def manifest_entry(t):
    return decided(t).select("document_id", F.coalesce("sha", "m_sha").alias("sha"), "etag", "acl", "version", F.col("deleted").alias("is_deleted"), F.lit("run1").alias("last_run_id"))


@query("tombstone_docs", f"WITH {LISTING_SQL} SELECT m.document_id, m_deleted OR l.document_id IS NULL AS is_deleted FROM manifest m LEFT JOIN listing l USING (document_id)")
def tombstone_docs(t):
    gone = D.deletions(manifest(t), listing(t)).withColumn("gone", F.lit(True))
    return manifest(t).join(gone, "document_id", "left").select("document_id", (F.col("m_deleted") | F.coalesce("gone", F.lit(False))).alias("is_deleted"))


@query("plan_source", f"{CLASSIFY_SQL} SELECT source, action, count(*) AS n, max(n_chars) AS largest, max(document_id) AS high FROM decided GROUP BY ALL")
def plan_source(t):
    return decided(t).groupBy("source", "action").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("largest"), F.max("document_id").alias("high"))


_OUTCOME_SQL = "CASE WHEN document_id % 37 = 0 THEN 'failed' WHEN action = 'create' THEN 'created' WHEN action IN ('update', 'acl_only') THEN 'updated' WHEN action = 'delete' THEN 'deleted' ELSE 'skipped' END"
_COUNTS_SQL = f"{CLASSIFY_SQL}, o AS (SELECT source, n_chars, {_OUTCOME_SQL} AS outcome FROM decided), k AS (SELECT source, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{x}') AS {x}" for x in ("created", "updated", "skipped", "deleted", "failed")) + ", sum(n_chars)::BIGINT AS chars FROM o GROUP BY source)"


def counters(t):
    outcome = F.when(F.col("document_id") % 37 == 0, "failed").when(F.col("action") == "create", "created").when(F.col("action").isin("update", "acl_only"), "updated").when(F.col("action") == "delete", "deleted").otherwise("skipped")
    o = decided(t).withColumn("outcome", outcome)
    return o.groupBy("source").agg(*(F.count(F.when(F.col("outcome") == x, 1)).alias(x) for x in ("created", "updated", "skipped", "deleted", "failed")), F.sum("n_chars").alias("chars"))


@query("run_counters", f"{_COUNTS_SQL} SELECT * FROM k")
def run_counters(t):
    return counters(t)


@query("run_status", f"{_COUNTS_SQL} SELECT source, CASE WHEN failed = 0 THEN 'succeeded' WHEN created + updated + deleted > 0 THEN 'partial' ELSE 'failed' END AS status FROM k")
def run_status(t):
    return counters(t).select("source", D.run_status(F.col("failed"), F.col("created") + F.col("updated") + F.col("deleted")).alias("status"))


@query("finalize_run", f"{_COUNTS_SQL} SELECT sum(created)::BIGINT AS created, sum(updated)::BIGINT AS updated, sum(skipped)::BIGINT AS skipped, sum(failed)::BIGINT AS failed, count(*) AS sources FROM k")
def finalize_run(t):
    return counters(t).agg(*(F.sum(x).alias(x) for x in ("created", "updated", "skipped", "failed")), F.count(F.lit(1)).alias("sources"))


@query("sched_guard", "SELECT event_id, dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) >= 22 OR hour(ts) < 6) AS open FROM events")
def sched_guard(t):
    return t.events.select("event_id", D.within_hours(F.col("ts"), 22, 6).alias("open"))


@query("mirror_items", f"{CLASSIFY_SQL} SELECT document_id, source, action, reason, version FROM decided WHERE action <> 'skip'")
def mirror_items(t):
    return decided(t).where("action <> 'skip'").select("document_id", "source", "action", "reason", "version")


_SNAP_SQL = "SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price FROM orders"


def _snapshot(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))


@query("upsert_points", f"WITH s AS ({_SNAP_SQL}) SELECT id, owner, CASE WHEN id % 5 = 0 THEN price * 2 ELSE price END AS price FROM s")
def upsert_points(t):
    s = _snapshot(t)
    return D.upsert(s, s.where("id % 5 = 0").withColumn("price", F.col("price") * 2), "id")


@query("upsert_chunks", f"WITH s AS ({_SNAP_SQL}) SELECT id, owner FROM s WHERE owner = 1")
def upsert_chunks(t):
    return D.single_tenant(_snapshot(t).where("owner = 1").select("id", "owner"), "owner")


@query("soft_delete", f"WITH s AS ({_SNAP_SQL}) SELECT id, owner IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS is_deleted FROM s")
def soft_delete(t):
    return S.soft_delete(_snapshot(t), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("owner")), "owner").select("id", "is_deleted")


@query("hard_delete", f"WITH s AS ({_SNAP_SQL}) SELECT id FROM s WHERE NOT (owner % 10 = 0)")
def hard_delete(t):
    return S.hard_delete_where(_snapshot(t), F.col("owner") % 10 == 0).select("id")


@query("acl_rewrite", f"WITH s AS ({_SNAP_SQL}) SELECT id, coalesce(CASE WHEN c_acctbal < 0 THEN 'restricted' END, 'internal') AS classification FROM s LEFT JOIN customer ON owner = c_custkey")
def acl_rewrite(t):
    new = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("owner"), F.lit("restricted").alias("classification"))
    return S.rewrite(_snapshot(t).withColumn("classification", F.lit("internal")), new, "owner").select("id", "classification")


@query("tombstone_missing", "SELECT DISTINCT o_custkey AS document_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def tombstone_missing(t):
    kept = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"))
    return S.missing(t.orders.select(F.col("o_custkey").alias("document_id")), kept, "document_id")


@query("count_where", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def count_where(t):
    return S.counts(t.orders, F.col("o_totalprice") > 1000, "o_orderstatus")


@query("prune_doc", "SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)")
def prune_doc(t):
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.prune(t.lineitem, gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("doc_upsert", f"WITH {LISTING_SQL} SELECT document_id, coalesce(m_version, 1) + CASE WHEN sha IS NOT NULL AND m_sha IS NOT NULL AND sha <> m_sha THEN 1 ELSE 0 END AS version, false AS is_deleted FROM listing LEFT JOIN manifest USING (document_id) WHERE NOT deleted")
def doc_upsert(t):
    return S.next_versions(listing(t).where("not deleted"), manifest(t), "document_id").select("document_id", "version", F.lit(False).alias("is_deleted"))


@query("docs_delete", "SELECT doc_id, doc_id % 17 = 0 OR source = 'src3' AS is_deleted FROM documents")
def docs_delete(t):
    return S.soft_delete_where(t.documents, (F.col("doc_id") % 17 == 0) | (F.col("source") == "src3")).select("doc_id", "is_deleted")


@query("src_sql", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS watermark FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' ")
def src_sql(t):
    """Rows past a high-water mark; strictly, so a row that ties with the mark is not read again."""
    return t.orders.where("o_orderdate > timestamp'1995-06-01'").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("watermark"))


@query("src_sql_stmt", "SELECT o_orderkey FROM orders WHERE o_orderkey > 700")
def src_sql_stmt(t):
    from ..sources.tables import incremental

    return incremental(t.spark, t.orders, "o_orderkey", 700).select("o_orderkey")


@query("watermark_max", "SELECT o_orderpriority, max(epoch(o_orderdate))::BIGINT AS watermark FROM orders GROUP BY 1")
def watermark_max(t):
    return t.orders.groupBy("o_orderpriority").agg(F.unix_timestamp(F.max("o_orderdate")).alias("watermark"))


_ROW_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '## Name' || chr(10) || chr(10) || c_name || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE chr(10) || chr(10) || '## Segment' || chr(10) || chr(10) || c_mktsegment END END AS body, c_custkey % 9 = 0 AS is_deleted FROM customer WHERE c_custkey % 50 <> 0"


@query("row_to_doc", _ROW_SQL)
def row_to_doc(t):
    from ..sources.tables import row_documents

    c = t.customer.select(F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("c_custkey"), "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_custkey") % 9 == 0).alias("gone"))
    return row_documents(c, "c_custkey", {"c_name": "Name", "c_mktsegment": "Segment"}, "gone")


@query("row_body", "SELECT s_suppkey, '## Supplier' || chr(10) || chr(10) || s_name AS body FROM supplier")
def row_body(t):
    from ..sources.tables import row_body as body

    return t.supplier.select("s_suppkey", body({"s_name": "Supplier"}).alias("body"))


@query("row_acl", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'n' || c_nationkey ELSE 'g0' END AS grp FROM customer")
def row_acl(t):
    from ..operators.access import parse_list

    own = parse_list(F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    return t.customer.select("c_custkey", F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("g0")).alias("grp"))
