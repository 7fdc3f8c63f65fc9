"""Queries of evaluation, quality gates, lineage, tools and operations.

An evaluation item is a labelled document; its metrics are quality, a share from its
id and a latency, null where unmeasured; its category is the document's source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import lineage as L
from ..operators import tools
from .base import CORPUS_SQL, PRINCIPALS_SQL, query

ITEMS_SQL = "items AS (SELECT l.doc_id AS item_id, d.source AS category, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE l.quality::DOUBLE END AS faithfulness, CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE (l.doc_id % 100) / 100.0::DOUBLE END AS recall, 1.0::DOUBLE - l.toxic AS acl_leak, (l.doc_id % 1000) * 30.0::DOUBLE AS latency, (l.doc_id % 50) / 1000.0::DOUBLE AS cost, l.doc_id % 6 <> 0 AS passed FROM labels l JOIN documents d USING (doc_id))"
#: Fixed: floors of metrics (a ceiling for latency); the first is hard.
FLOORS = [("acl_leak", 1.0, True, False), ("faithfulness", 0.8, False, False), ("recall", 0.7, False, False), ("latency", 20000.0, False, True)]


def items(t):
    i = F.col("doc_id")
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return j.select(
        i.alias("item_id"), F.col("source").alias("category"), F.when(i % 9 != 0, F.col("quality").cast("double")).alias("faithfulness"), F.when(i % 7 != 0, (i % 100) / 100).alias("recall"),
        (1.0 - F.col("toxic")).alias("acl_leak"), ((i % 1000) * 30.0).alias("latency"), ((i % 50) / 1000).alias("cost"), (i % 6 != 0).alias("passed"),
    )


METRICS = [m for m, *_ in FLOORS]
RULES = [V.Limit(*x) for x in FLOORS]
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + ", round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 6) AS pass_rate, count(*) AS n, round(sum(cost), 6) AS cost"


@query("ev_aggregate", f"WITH {ITEMS_SQL} SELECT {_MEANS} FROM items")
def ev_aggregate(t):
    return V.aggregate(items(t), METRICS)


@query("ev_category", f"WITH {ITEMS_SQL} SELECT category, {_MEANS} FROM items GROUP BY category")
def ev_category(t):
    return V.aggregate(items(t), METRICS, ("category",))


@query("ev_rollup", f"WITH {ITEMS_SQL} SELECT category, passed, count(*) AS n FROM items GROUP BY ROLLUP (category, passed)")
def ev_rollup(t):
    return V.rollup(items(t), "category", "passed")


@query("ev_fail_cat", f"WITH {ITEMS_SQL} SELECT category, count(*) AS n FROM items WHERE NOT passed GROUP BY 1")
def ev_fail_cat(t):
    return V.failing(items(t), "category")


@query("ev_worst", f"WITH {ITEMS_SQL} SELECT item_id FROM items ORDER BY passed, (coalesce(faithfulness, 0) + coalesce(recall, 0)), item_id LIMIT 10")
def ev_worst(t):
    """A top-k report: failing first, then the lowest scores."""
    return V.worst(items(t), ("faithfulness", "recall"), 10).select("item_id")


@query("ev_select", f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE category IN ('src0', 'src3') ORDER BY item_id LIMIT 15")
def ev_select(t):
    return V.chosen(items(t), "category", ("src0", "src3"), 15).select("item_id")


_MEASURED = ", ".join(f"count({m}) AS {m}" for m in METRICS)


@query("ev_thresholds", f"WITH {ITEMS_SQL}, c AS (SELECT {_MEASURED} FROM items), u AS (UNPIVOT c ON {', '.join(METRICS)} INTO NAME metric VALUE n) SELECT metric, floor, hard, n AS measured FROM (VALUES " + ", ".join(f"('{m}', {max(f, 1.0) if h else f}::DOUBLE, {str(h).lower()})" for m, f, h, _ in FLOORS) + ") AS v(metric, floor, hard) JOIN u USING (metric)")
def ev_thresholds(t):
    """Every limit with the number of items that it is held against."""
    n = items(t).agg(*(F.count(m).alias(m) for m in METRICS)).unpivot([], METRICS, "metric", "measured")
    return V.limits(t.spark, RULES).join(n, "metric").select("metric", "floor", "hard", "measured")


_LIMITS = "limits(metric, lim, hard, upper) AS (VALUES " + ", ".join(f"('{m}', {f}::DOUBLE, {str(h).lower()}, {str(u).lower()})" for m, f, h, u in FLOORS) + ")"


@query("ev_gate", f"WITH {ITEMS_SQL}, {_LIMITS}, a AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM items), u AS (UNPIVOT a ON {', '.join(METRICS)} INTO NAME metric VALUE v) SELECT metric, round(v, 6) AS value, v IS NULL OR CASE WHEN upper THEN v <= lim ELSE v >= lim END AS passed FROM limits LEFT JOIN u USING (metric)")
def ev_gate(t):
    return V.gate(items(t), RULES)


@query("ev_item_fail", f"WITH {ITEMS_SQL}, {_LIMITS}, u AS (SELECT * FROM (SELECT item_id, {', '.join(METRICS)} FROM items) UNPIVOT (v FOR metric IN ({', '.join(METRICS)}))) SELECT item_id, metric FROM u JOIN limits USING (metric) WHERE CASE WHEN upper THEN v > lim ELSE v < lim END")
def ev_item_fail(t):
    return V.item_failures(items(t), RULES)


@query("ev_compare", f"WITH {ITEMS_SQL}, cur AS (SELECT item_id, passed FROM items WHERE item_id % 8 <> 0), base AS (SELECT item_id, item_id % 5 <> 0 AS was FROM items WHERE item_id % 10 <> 1) SELECT item_id, CASE WHEN was IS NULL THEN 'new' WHEN passed IS NULL THEN 'missing' WHEN was AND NOT passed THEN 'regression' WHEN NOT was AND passed THEN 'fixed' ELSE 'same' END AS change FROM cur FULL JOIN base USING (item_id)")
def ev_compare(t):
    i = items(t)
    return V.compare(i.where("item_id % 8 <> 0"), i.where("item_id % 10 <> 1").withColumn("passed", F.col("item_id") % 5 != 0))


_LEAK_SQL = f"WITH {CORPUS_SQL}, {PRINCIPALS_SQL} SELECT persona, doc_id, CASE WHEN tenant_id <> tenant THEN 'tenant' WHEN classification_rank > clearance THEN 'clearance' WHEN list_contains(denied_users, usr) THEN 'denied' END AS leak FROM corpus JOIN principals ON doc_id % 4 = clearance"


def _leaks(t):
    return t.corpus.join(F.broadcast(t.principals), F.col("doc_id") % 4 == F.col("clearance")).select("persona", "doc_id", V.leak_kind().alias("leak"))


@query("ev_leak_chunk", _LEAK_SQL)
def ev_leak_chunk(t):
    return _leaks(t)


@query("ev_leak", f"SELECT persona, CASE WHEN count(leak) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM ({_LEAK_SQL}) GROUP BY persona")
def ev_leak(t):
    return V.leak_score(_leaks(t), "persona")


@query("ev_refusal", "SELECT event_id, (event_type = 'click') = (event_id % 2 = 0) AS correct FROM events")
def ev_refusal(t):
    return t.events.select("event_id", V.refusal_correct(F.col("event_type") == "click", F.col("event_id") % 2 == 0).alias("correct"))


@query("ev_tool", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM events")
def ev_tool(t):
    """Right if the expected tool is among those called, by name or by a dotted part of it."""
    calls = F.array(F.concat(F.lit("ui."), "event_type"), F.col("event_type"))
    return t.events.select("event_id", V.tool_score(calls, ("click", "view"), F.col("event_id") % 3 != 0).alias("score"))


@query("ev_substring", "SELECT doc_id, array_to_string(list_filter(['the', 'und', 'zzz'], lambda x: NOT contains(lower(text), x)), ',') AS missing, array_to_string(list_filter(['stupid', 'secret'], lambda x: contains(lower(text), x)), ',') AS forbidden FROM documents")
def ev_substring(t):
    return t.documents.select("doc_id", V.words_found("text", ("the", "und", "zzz"), False).alias("missing"), V.words_found("text", ("stupid", "secret")).alias("forbidden"))


@query("ev_recall", "WITH g AS (SELECT l_orderkey, list_distinct(list(l_partkey % 10)) AS want, list_distinct(list(l_suppkey % 10)) AS got FROM lineitem GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(want, got)) / len(want)::DOUBLE, 6) AS recall FROM g")
def ev_recall(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 10).alias("want"), F.collect_set(F.col("l_suppkey") % 10).alias("got"))
    return g.select("l_orderkey", V.set_recall("want", "got").alias("recall"))


@query("ev_similarity", "SELECT a.vec_id AS id, CASE WHEN a.vec_id % 10 = 0 THEN NULL ELSE round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) END AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2")
def ev_similarity(t):
    b = t.embeddings.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("other"))
    s = F.round(V.similarity("embedding", "other"), 6)
    return t.embeddings.join(b, "vec_id").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 != 0, s).alias("similarity"))


@query("ev_ceiling", f"WITH {CORPUS_SQL} SELECT tenant_id, max(classification_rank) AS ceiling FROM corpus GROUP BY 1")
def ev_ceiling(t):
    return V.highest(t.corpus, "tenant_id", "classification_rank", "ceiling")


RATES = [("click", 5.0, 25.0), ("view", 3.0, 15.0), ("purchase", 1.0, 5.0)]
_RATE_SQL = "rates(event_type, i, o) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, a, b in RATES) + ")"


@query("ev_cost", f"WITH {_RATE_SQL} SELECT user_id, round(sum((floor(value) * i + (event_id % 100) * o + (event_id % 7) * i * 0.1 + (event_id % 5) * i * 1.25) / 1e6), 9) AS cost FROM events JOIN rates USING (event_type) GROUP BY 1")
def ev_cost(t):
    """Tokens in and out, read from and written to the cache, at a rate table's prices a million."""
    e = F.col("event_id")
    return V.cost(t.events, {k: (i, o) for k, i, o in RATES}, "user_id", "event_type", F.floor("value"), e % 100, e % 7, e % 5)


@query("ev_usage", "SELECT event_type, count(*) AS calls, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1")
def ev_usage(t):
    return V.usage(t.events, "event_type", F.floor("value"))


_AP = "SELECT user_id, event_id % 3 = 0 AS useful, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events"


@query("ev_ctx_precision", f"SELECT user_id, round(coalesce(avg(hits / rank) FILTER (WHERE useful), 0), 6) AS score FROM (SELECT *, sum(CASE WHEN useful THEN 1.0 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rank) AS hits FROM ({_AP})) GROUP BY user_id")
def ev_ctx_precision(t):
    """Average precision over the ranks of useful rows."""
    return V.average_precision(t.events, "user_id", "event_id", F.col("event_id") % 3 == 0)


@query("ev_ctx_recall", "SELECT user_id, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS score FROM events GROUP BY 1")
def ev_ctx_recall(t):
    return V.share(t.events, "user_id", F.col("value") > 50)


@query("ev_faithful", "SELECT c_custkey, round(coalesce(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 WHEN o_totalprice IS NULL THEN NULL ELSE 0 END), 1.0), 6) AS score FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def ev_faithful(t):
    return V.share(t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left"), "c_custkey", F.col("o_totalprice") > 100000, 1.0)


@query("ev_relevancy", "SELECT a.label, round(avg(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3 GROUP BY 1")
def ev_relevancy(t):
    b = t.embeddings.select((F.col("vec_id") - 3).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").groupBy("label").agg(F.round(F.avg(V.similarity("embedding", "other")), 6).alias("score"))


@query("ev_correct", "SELECT event_id, round(0.75 * CASE WHEN event_id % 10 + event_id % 4 + event_id % 3 = 0 THEN 0 ELSE 2.0 * (event_id % 10) / (2 * (event_id % 10) + event_id % 4 + event_id % 3) END + 0.25 * least(1, value / 100), 6) AS score FROM events WHERE event_id % 10 + event_id % 4 + event_id % 3 > 0")
def ev_correct(t):
    tp, fp, fn = (F.col("event_id") % k for k in (10, 4, 3))
    return t.events.where(tp + fp + fn > 0).select("event_id", F.round(V.correctness(tp, fp, fn, F.col("value") / 100), 6).alias("score"))


@query("ops_metrics", "SELECT event_type, least(9, floor(value / 25))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def ops_metrics(t):
    return V.histogram(t.events, "event_type", F.col("value"), 25, 9)


LINEAGE_SQL = """edges AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r0', 'r1' UNION ALL SELECT 'r1', 'r0')"""


def edges(t):
    s = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    e = t.orders.select(s("o", "o_orderkey").alias("child"), s("c", "o_custkey").alias("parent")).union(t.customer.select(s("c", "c_custkey"), s("n", "c_nationkey"))).union(t.nation.select(s("n", "n_nationkey"), s("r", "n_regionkey")))
    return e.union(t.values([("r0", "r1"), ("r1", "r0")], "child string, parent string"))


@query("lin_walk", f"WITH RECURSIVE {LINEAGE_SQL}, walk AS (SELECT child AS subject, parent AS node, 1 AS depth FROM edges WHERE child IN ('o1', 'o2', 'o3', 'c5') UNION SELECT subject, parent, depth + 1 FROM walk JOIN edges ON node = child WHERE depth < 4) SELECT subject, node, min(depth) AS depth FROM walk WHERE node <> subject GROUP BY ALL")
def lin_walk(t):
    return L.walk(edges(t), ["o1", "o2", "o3", "c5"], 4)


@query("lin_doc", "SELECT o_orderkey, c_name, n_name, r_name, count(l_linenumber) AS items FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def lin_doc(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).join(n, "o_orderkey", "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("items", F.lit(0)).alias("items"))


@query("tool_route", "SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 THEN 'both' WHEN event_type = 'click' THEN 'tools' WHEN value > 10 THEN 'retrieval' ELSE 'neither' END AS route FROM events")
def tool_route(t):
    return t.events.select("event_id", tools.route(F.col("event_type") == "click", F.col("value") > F.when(F.col("event_type") == "click", 50).otherwise(10)).alias("route"))


@query("tool_loop", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(value / 10) ORDER BY event_id) > 2 AS looped FROM events")
def tool_loop(t):
    return tools.loops(t.events.withColumn("argument", F.floor(F.col("value") / 10)), ("user_id", "event_type", "argument"), "event_id", 2).select("event_id", "looped")


@query("tool_project", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def tool_project(t):
    return t.events.select("event_id", tools.projected("props", "k").alias("k"))


@query("tool_visible", "WITH tools(tool, need) AS (VALUES ('search', []::VARCHAR[]), ('sql', ['building']), ('audit', ['machinery', 'building'])) SELECT c_custkey, tool FROM customer JOIN tools ON len(need) = 0 OR list_has_any(need, [lower(c_mktsegment), 'user'])")
def tool_visible(t):
    """Customers as callers, with their segment as a role."""
    callers = t.customer.select("c_custkey", F.array(F.lower("c_mktsegment"), F.lit("user")).alias("roles"))
    return tools.visible(callers, {"search": (), "sql": ("building",), "audit": ("machinery", "building")}).select("c_custkey", "tool")