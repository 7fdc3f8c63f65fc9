"""Queries of keyed stores: upserts, appends and lookups as new snapshots; streams and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store as S
from ..operators.delta import upsert
from ..operators.graph import new_folder
from ..sources import feed, files, web
from ..streaming import events as SE
from ..streaming import sessions as SW
from .base import query


@query("tenant_upsert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'new ' || n_name ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'added'")
def tenant_upsert(t):
    old = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    new = old.where("id % 4 = 0").withColumn("name", F.concat(F.lit("new "), "name")).union(t.values([(100, "added")], "id int, name string"))
    return upsert(old, new, "id")


@query("user_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 1735689600 ELSE 0 END AS last_seen FROM customer")
def user_upsert(t):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.lit(0).alias("last_seen"))
    return upsert(old, old.where("id % 5 = 0").withColumn("last_seen", F.lit(1735689600)), "id")


@query("sources_list", "SELECT s_suppkey, row_number() OVER (ORDER BY s_name) AS place FROM supplier WHERE s_nationkey = 3")
def sources_list(t):
    """One tenant's sources by name: a bounded listing."""
    return S.listed(t.supplier.where("s_nationkey = 3"), "s_nationkey", ("s_name",)).select("s_suppkey", "place")


@query("run_record", "SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, CASE WHEN source = 'src1' THEN 'rewritten' ELSE 'first' END AS state FROM documents GROUP BY source")
def run_record(t):
    runs = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars")).withColumn("state", F.lit("first"))
    return upsert(runs, runs.where("source = 'src1'").withColumn("state", F.lit("rewritten")), "source")


@query("item_record", "SELECT doc_id, 'run1' AS run_id FROM documents UNION ALL SELECT doc_id, 'run2' FROM documents WHERE doc_id % 6 = 0")
def item_record(t):
    d = t.documents.select("doc_id")
    return d.withColumn("run_id", F.lit("run1")).union(d.where("doc_id % 6 = 0").withColumn("run_id", F.lit("run2")))


@query("sess_get_create", "SELECT DISTINCT user_id AS session FROM events UNION SELECT c_custkey FROM customer")
def sess_get_create(t):
    return S.get_or_create(t.events.select(F.col("user_id").alias("session")), t.customer.select(F.col("c_custkey").alias("session")), "session").select("session")


@query("sess_get", "SELECT conv_id, turn FROM conversations WHERE conv_id = 3")
def sess_get(t):
    return t.conversations.where("conv_id = 3").select("conv_id", "turn")


@query("sess_delete", "SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 6 = 0)")
def sess_delete(t):
    return S.hard_delete_where(t.conversations, F.col("conv_id") % 6 == 0).select("conv_id", "turn")


@query("msg_append", "SELECT conv_id, count(*) + 1 AS n, max(turn) + 1 AS last FROM conversations GROUP BY 1")
def msg_append(t):
    c = S.append(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", text=F.lit("more"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))


@query("tool_log", "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE value > 90) AS errors FROM events GROUP BY 1")
def tool_log(t):
    return t.events.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") > 90).alias("errors"))


@query("profile_get", "SELECT c_custkey, coalesce(any_value(o_orderpriority), 'none') = 'none' AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def profile_get(t):
    have = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    asked = t.customer.select("c_custkey")
    return S.get_or_create(have.join(asked, "c_custkey", "left_semi"), asked, "c_custkey")


@query("profile_save", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'saved' ELSE c_mktsegment END AS profile FROM customer")
def profile_save(t):
    p = t.customer.select("c_custkey", F.col("c_mktsegment").alias("profile"))
    return upsert(p, p.where("c_custkey % 3 = 0").withColumn("profile", F.lit("saved")), "c_custkey")


@query("consent_set", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) AS is_deleted FROM orders")
def consent_set(t):
    out = t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.soft_delete(t.orders, out, "o_custkey").select("o_orderkey", "is_deleted")


@query("mem_upsert", "SELECT o_orderkey, o_orderkey % 8 = 0 AS superseded FROM orders")
def mem_upsert(t):
    m = t.orders.select("o_orderkey", F.lit(False).alias("superseded"))
    return upsert(m, m.where("o_orderkey % 8 = 0").withColumn("superseded", F.lit(True)), "o_orderkey")


@query("mem_delete", "SELECT o_orderkey, o_custkey = 7 AS is_deleted FROM orders")
def mem_delete(t):
    return S.soft_delete_where(t.orders, F.col("o_custkey") == 7).select("o_orderkey", "is_deleted")


@query("ev_run_write", "SELECT source, count(*) AS items, sum(quality)::BIGINT AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def ev_run_write(t):
    return t.labels.join(t.documents, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("quality").alias("passed"))


@query("ev_result_write", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE quality END AS quality FROM labels")
def ev_result_write(t):
    r = t.labels.select("doc_id", "quality")
    return upsert(r, r.where("doc_id % 5 = 0").withColumn("quality", F.lit(1)), "doc_id")


@query("admin_runs", "SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5")
def admin_runs(t):
    return S.newest(t.events.where("event_type = 'purchase'"), "user_id", (F.desc("ts"), "event_id"), 5).select("user_id", "event_id")


@query("feedback", "SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')")
def feedback(t):
    """Only redacted comments are taken."""
    return t.conversations.where((F.col("role") == "user") & ~F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")).select("conv_id", "turn", F.length("text").alias("n"))


@query("audit", "SELECT event_id, event_type || ':' || user_id AS entry FROM events")
def audit(t):
    return t.events.select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("entry"))


@query("src_registry", "SELECT ['crawl', 'feed', 'files', 'jdbc', 'rows', 'sitemap'][1 + substr(source, 4)::INT % 6] AS kind, count(DISTINCT source) AS sources, count(*) AS documents FROM documents GROUP BY 1")
def src_registry(t):
    """The sources of the documents by the reader that each is given."""
    from ..sources.registry import READERS

    kinds = F.array(*map(F.lit, sorted(READERS)))
    kind = F.element_at(kinds, (1 + F.substring("source", 4, 9).cast("int") % len(READERS)).cast("int"))
    return t.documents.groupBy(kind.alias("kind")).agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("documents"))


@query("src_local_fs")
def src_local_fs(t):
    return files.listing(t.spark, t.folder, "*.parquet").select("name", "size")


@query("src_http_crawl")
def src_http_crawl(t):
    """Breadth first from a few seeds over the pages table, three levels."""
    return web.crawl(t.pages.select("url", "html"), t.pages.where("page_id % 25 = 0").select("url"), 3)


@query("src_sitemap", "SELECT page_id, url FROM pages WHERE page_id >= 10")
def src_sitemap(t):
    """A sitemap made from the pages, read back as XML: only entries at or after a date."""
    day = F.when(F.col("page_id") >= 10, "2025-02-01").otherwise("2024-01-01")
    maps = t.pages.select("page_id", F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url></urlset>")).alias("xml"))
    return web.sitemap(maps, "2025-01-01").select("page_id", "url")


@query("stream_windows", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(t):
    """The stream's tumbling windows, over a bounded read."""
    return SE.hourly(t.events).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, session")
def stream_sessions(t):
    return SE.sessions(t.events).select("user_id", F.unix_timestamp("session.start").alias("start"), "n")


@query("tool_rate")
def tool_rate(t):
    """A token bucket for each user: every call refills it by the time passed."""
    return SE.rate_limited(t.events)


@query("tool_breaker")
def tool_breaker(t):
    return SE.breaker(t.events)


@query("src_graph_delta", "SELECT doc_id::VARCHAR AS item_id, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS size, 'e' || (doc_id % 6) AS etag, doc_id % 9 = 0 AS deleted FROM documents UNION ALL SELECT doc_id::VARCHAR, NULL, 'gone', true FROM documents WHERE doc_id % 8 = 3")
def src_graph_delta(t):
    """Documents as a change feed, written page by page and read back over the feed's source; some change again on a later page."""
    d = t.documents
    i = F.col("doc_id")
    item = [i.cast("string").alias("id"), F.concat(F.lit("doc "), i.cast("string")).alias("name")]
    once = d.select(*item, F.concat(F.lit("e"), (i % 6).cast("string")).alias("etag"), F.col("n_chars").alias("size"), F.lit("2025-01-01").alias("modified"), (i % 9 == 0).alias("deleted"), F.floor(i / 500).alias("page"), i.alias("pos"))
    again = d.where(i % 8 == 3).select(*item, F.lit("gone"), F.lit(None).cast("long"), F.lit("2025-02-01"), F.lit(True), 1_000_000_000 + F.floor(i / 500), i)
    folder = new_folder(t.spark, "feed")
    feed.write_pages(once.union(again), folder)
    return feed.changes(t.spark, folder).select("item_id", "size", "etag", "deleted")


_SESSION_SQL = """WITH g AS (SELECT event_type AS tenant_id, user_id AS session_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY tenant_id, session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT tenant_id, session_id, epoch_us(min(ts))::BIGINT AS opened, epoch_us(max(ts))::BIGINT AS closed, count(*) AS turns, sum(event_id % 7)::BIGINT AS tokens, array_to_string(list(event_id ORDER BY ts, event_id)[-20:], ',') AS kept FROM s GROUP BY tenant_id, session_id, island"""


def session_turns(t):
    return t.events.select(F.col("event_type").alias("tenant_id"), F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("turn"), (F.col("event_id") % 7).alias("tokens"))


@query("sess_store", _SESSION_SQL)
def sess_store(t):
    """The windows of all sessions, as keyed state gives them one by one on a stream."""
    w = SW.windows(session_turns(t))
    return w.select("tenant_id", "session_id", F.unix_micros("opened").alias("opened"), F.unix_micros("closed").alias("closed"), "turns", "tokens", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))
