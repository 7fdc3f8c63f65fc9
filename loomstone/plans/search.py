"""Queries of search, fusion and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import conditions as C
from ..operators import search as S
from .access import VISIBLE_SQL
from .base import query

ASKED = [(1, "engineer", "the tion ing and"), (2, "analyst", "der die und ein"), (3, "admin", "les des que ment"), (4, "intern", "los que ción con")]
_TERMS = [(q, p, w) for q, p, text in ASKED for w in text.split()]
TERMS_SQL = "terms(query, persona, term) AS (VALUES " + ", ".join(f"({q}, '{p}', '{w}')" for q, p, w in _TERMS) + ")"


def asked(t, *columns):
    return t.values(_TERMS, "query long, persona string, term string").select(*columns)


_KNN = "SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id"


def nearest(t, k=S.PREFETCH, floor=None):
    """Every hundredth vector against all others."""
    return S.knn(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0, k, floor)


def scored(t):
    """Every hundredth vector with all others."""
    return S.scores(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


@query("cosine", "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    e = t.embeddings
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("id"), F.round(S.cosine("embedding", "other"), 6).alias("cosine"))


@query("dense_knn", f"SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM ({_KNN}) WHERE score >= 0.05) WHERE rn <= 10")
def dense_knn(t):
    return nearest(t, 10, 0.05).select("query", "id", F.round("score", 6).alias("score"))


_BM_SQL = r"""tok AS (SELECT doc_id AS id, unnest(w) AS term, len(w) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM docs)),
shape AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS avgdl FROM docs),
tf AS (SELECT id, term, count(*) AS tf, max(dl) AS dl FROM tok GROUP BY id, term), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN dfs USING (term) JOIN terms USING (term) CROSS JOIN shape GROUP BY query, id)"""


@query("bm25", f"WITH {TERMS_SQL}, docs AS (SELECT * FROM documents), {_BM_SQL} SELECT query, id, round(score, 6) AS score FROM bm")
def bm25(t):
    return S.bm25(asked(t, "query", "term"), t.documents).select("query", "id", F.round("score", 6).alias("score"))


_VEC_SQL = """idf AS (SELECT term, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM dfs CROSS JOIN shape),
v0 AS (SELECT id, ('0x' || substr(md5(term), 1, 6))::BIGINT % 512 AS bucket, sum(tf * idf) AS w FROM tf JOIN idf USING (term) GROUP BY ALL), v AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM v0),
q0 AS (SELECT query, ('0x' || substr(md5(term), 1, 6))::BIGINT % 512 AS bucket, sum(coalesce(idf, ln(n + 1.0) + 1)) AS w FROM terms LEFT JOIN idf USING (term) CROSS JOIN shape GROUP BY ALL), qv AS (SELECT query, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS w FROM q0),
dense AS (SELECT query, id, sum(v.w * qv.w) AS score FROM v JOIN qv USING (bucket) GROUP BY ALL)"""


@query("embed_tfidf", f"WITH {TERMS_SQL}, docs AS (SELECT * FROM documents), {_BM_SQL}, {_VEC_SQL} SELECT id, bucket, round(w, 6) AS w FROM v")
def embed_tfidf(t):
    v = S.tfidf(t.documents)
    return v.select("id", "bucket", F.round("w", 6).alias("w"))


_OWN_SQL = r"""docs AS (SELECT DISTINCT persona, doc_id, text FROM visible),
own AS (SELECT persona, doc_id AS id, unnest(w) AS term, len(w) AS dl FROM (SELECT persona, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM docs)),
shape AS (SELECT persona, count(*) AS n, avg(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS avgdl FROM docs GROUP BY persona),
tf AS (SELECT persona, id, term, count(*) AS tf, max(dl) AS dl FROM own GROUP BY ALL), dfs AS (SELECT persona, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN dfs USING (persona, term) JOIN terms USING (persona, term) JOIN shape USING (persona) GROUP BY query, id),
idf AS (SELECT persona, term, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM dfs JOIN shape USING (persona)),
v0 AS (SELECT persona, id, ('0x' || substr(md5(term), 1, 6))::BIGINT % 512 AS bucket, sum(tf * idf) AS w FROM tf JOIN idf USING (persona, term) GROUP BY ALL), v AS (SELECT persona, id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY persona, id)) AS w FROM v0),
q0 AS (SELECT query, persona, ('0x' || substr(md5(term), 1, 6))::BIGINT % 512 AS bucket, sum(coalesce(idf, ln(n + 1.0) + 1)) AS w FROM terms LEFT JOIN idf USING (persona, term) JOIN shape USING (persona) GROUP BY ALL), qv AS (SELECT query, persona, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS w FROM q0),
dense AS (SELECT query, id, sum(v.w * qv.w) AS score FROM v JOIN qv USING (persona, bucket) GROUP BY ALL)"""
_RANKED_SQL = f"""{VISIBLE_SQL}, {TERMS_SQL}, {_OWN_SQL},
b1 AS (SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= 60),
b2 AS (SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM dense) WHERE rank <= 60)"""
_FUSED_SQL = f"{_RANKED_SQL}, f AS (SELECT query, id, sum(1 / (60.0 + rank)) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY query, id), fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 30)"


def branches(t):
    """Both branches of every query, over what its own persona may read."""
    rights = A.visible(t.corpus.drop("text"), t.principals).select("persona", F.col("doc_id").alias("id")).distinct()
    nine = lambda d: d.withColumn("score", F.round("score", 9))  # noqa: E731  so that engines order alike
    found = S.search_as(asked(t, "query", "persona", "term"), S.term_counts(t.documents), rights)
    return tuple(S.top(nine(d), "query", "score", S.PREFETCH, "id") for d in found)


def fused(t):
    return S.top(S.rrf(*branches(t)).withColumn("score", F.round("score", 9)), "query", "score", S.FUSED, "id")


@query("hybrid_rrf", f"{_FUSED_SQL} SELECT query, id, round(score, 6) AS score, rank FROM fused")
def hybrid_rrf(t):
    return fused(t).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("retrieve", f"{_FUSED_SQL}, k AS (SELECT query, id, id % 7 AS document, rank, row_number() OVER (PARTITION BY query, id % 7 ORDER BY rank) AS own FROM fused), s AS (SELECT *, sum(CASE WHEN own <= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) - CASE WHEN own <= 3 THEN 1 ELSE 0 END AS before FROM k) SELECT query, id, rank, CASE WHEN before >= 8 THEN 'top_n' WHEN own > 3 THEN 'max_per_document' END AS dropped_reason FROM s")
def retrieve(t):
    """Readable documents, two branches, fusion, caps; what is dropped stays with its reason."""
    r = fused(t).withColumn("document", F.col("id") % 7)
    return S.capped(r, "query", "document", "rank").select("query", "id", F.col("rank").cast("long").alias("rank"), "dropped_reason")


@query("doc_cap", "WITH r AS (SELECT user_id AS query, event_type AS document, event_id AS rank, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS own FROM events), s AS (SELECT *, sum(CASE WHEN own <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) - CASE WHEN own <= 1 THEN 1 ELSE 0 END AS before FROM r) SELECT query, rank, CASE WHEN before >= 3 THEN 'top_n' WHEN own > 1 THEN 'max_per_document' END AS dropped_reason FROM s")
def doc_cap(t):
    r = t.events.select(F.col("user_id").alias("query"), F.col("event_type").alias("document"), F.col("event_id").alias("rank"))
    return S.capped(r, "query", "document", "rank", 3, 1).select("query", "rank", "dropped_reason")


_FUSION_SQL = f"WITH k AS ({_KNN}), b AS (SELECT query, id, round(score, 9) AS score FROM k), z AS (SELECT *, avg(score) OVER w AS m, stddev_pop(score) OVER w AS s FROM b WINDOW w AS (PARTITION BY query)) SELECT query, id, round(least(1, greatest(0, (score - (m - 3 * s)) / (6 * s))), 6) AS score FROM z"


@query("fusion_kind", _FUSION_SQL)
def fusion_kind(t):
    b = scored(t).select("query", "id", F.round("score", 9).alias("score"))
    return S.dbsf(b).select("query", "id", F.round("score", 6).alias("score"))


@query("rrf_offline", f"WITH k AS ({_KNN}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM k WHERE score > 0) SELECT query, id, round(0.05 * score, 6) AS score, round(1 / (60.0 + rank), 9) AS fused FROM r")
def rrf_offline(t):
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    r = scored(t).where("score > 0").withColumn("rank", F.row_number().over(best))
    return r.select("query", "id", F.round(0.05 * F.col("score"), 6).alias("score"), F.round(1 / (60.0 + F.col("rank")), 9).alias("fused"))


@query("probe_build", "SELECT conv_id, probe, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn, text AS probe, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS rn FROM conversations) WHERE rn = 1 QUALIFY place <= 4")
def probe_build(t):
    first = F.row_number().over(Window.partitionBy("conv_id", F.lower("text")).orderBy("turn"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("rn", first).where("rn = 1").select("conv_id", F.col("text").alias("probe"), place.cast("long").alias("place")).where("place <= 4")


@query("probe_union", "SELECT l_orderkey AS query, l_suppkey AS id, max(l_quantity) AS score, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS probe FROM lineitem GROUP BY ALL")
def probe_union(t):
    """The best score of a row over all probes; the first probe wins a tie."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("id")).agg(F.max("l_quantity").alias("score"), F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("probe"))


_RERANK_SQL = "WITH r AS (SELECT o_custkey AS query, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def _ranked(t):
    w = Window.partitionBy("query")
    r = t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return r.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("n", F.count(F.lit(1)).over(w))


@query("rerank", f"{_RERANK_SQL} SELECT query, id, CASE WHEN rank > 50 THEN 'candidate_limit' WHEN score < 1000 THEN 'min_score' WHEN rank > 8 THEN 'rerank_top_n' END AS dropped_reason FROM r")
def rerank(t):
    reason = F.when(F.col("rank") > 50, "candidate_limit").when(F.col("score") < 1000, "min_score").when(F.col("rank") > 8, "rerank_top_n")
    return _ranked(t).select("query", "id", reason.alias("dropped_reason"))


@query("rerank_noop", f"{_RERANK_SQL} SELECT query, id, round((n - rank + 1) / n::DOUBLE, 6) AS score FROM r")
def rerank_noop(t):
    return _ranked(t).select("query", "id", F.round((F.col("n") - F.col("rank") + 1) / F.col("n"), 6).alias("score"))


@query("rerank_fixture", f"SELECT query, id, round(1 / (1 + exp(-12 * (score - 0.30))), 6) AS score FROM ({_KNN})")
def rerank_fixture(t):
    return scored(t).select("query", "id", F.round(1 / (1 + F.exp(-12 * (F.col("score") - 0.30))), 6).alias("score"))


@query("relevance_cal", "SELECT event_id, round(1 / (1 + exp(-least(60, greatest(-60, value - 50)))), 6) AS calibrated, round(least(1, greatest(0, value / 2000 / 0.05)), 6) AS plain FROM events")
def relevance_cal(t):
    return t.events.select("event_id", F.round(S.relevance(F.col("value") - 50, True), 6).alias("calibrated"), F.round(S.relevance(F.col("value") / 2000, False), 6).alias("plain"))


@query("minmax_norm", "SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 1.0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def minmax_norm(t):
    return t.orders.select("o_orderkey", F.round(S.minmax("o_totalprice", "o_custkey"), 6).alias("score"))


@query("mmr")
def mmr(t):
    own = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.mmr(nearest(t, 20).join(own, "id").withColumnRenamed("score", "relevance"))


@query("retrieve_ids", f"{VISIBLE_SQL}, plan AS (SELECT range AS id, row_number() OVER (ORDER BY range) AS rank FROM range(0, 200, 7)) SELECT persona, id, round((29 - rank + 1) / 29.0, 6) AS score FROM plan JOIN visible ON doc_id = id")
def retrieve_ids(t):
    """Cached ids through the rule as it is now; what may no longer be read is silently missing."""
    plan = t.values([(list(range(0, 200, 7)),)], "ids array<long>").select(F.posexplode("ids").alias("rank", "doc_id"))
    return A.visible(t.corpus, t.principals).join(F.broadcast(plan), "doc_id").select("persona", F.col("doc_id").alias("id"), F.round((29 - F.col("rank")) / 29, 6).alias("score"))


@query("distinct_docs", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)")
def distinct_docs(t):
    d = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return d.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("place"))


@query("max_score", "SELECT c_custkey, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def max_score(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("top"))


#: Calls of the search tool: who calls, the words, the arguments, and what these leave in SQL.
SEARCHES = [(1, "engineer", "the tion ing and", {"languages": ["en"], "doc_types": ["policy", "faq", "runbook", "contract"]}, "lang = 'en' AND doc_type IN ('policy', 'faq', 'runbook', 'contract')"), (2, "intern", "los que ción con", {"languages": ["es", "en"]}, "lang IN ('es', 'en')"), (3, "admin", "les des que ment", {"languages": [], "date_to": "2024-01-20"}, "modified <= 1705708800")]
_CALL_TERMS_SQL = "terms(query, persona, term) AS (VALUES " + ", ".join(f"({q}, 'call {q}', '{w}')" for q, _, text, *_ in SEARCHES for w in text.split()) + ")"
_CALL_DOCS_SQL = VISIBLE_SQL.replace("visible AS (", "seen AS (") + ", visible AS (" + " UNION ALL ".join(f"SELECT 'call {q}' AS persona, doc_id, text FROM seen WHERE persona = '{p}' AND {sql}" for q, p, _, _, sql in SEARCHES) + ")"
_SEARCH_SQL = _FUSED_SQL.replace(f"{VISIBLE_SQL}, {TERMS_SQL}", f"{_CALL_DOCS_SQL}, {_CALL_TERMS_SQL}")


@query("tool_search", f"{_SEARCH_SQL} SELECT query AS call, id, round(score, 6) AS score, rank FROM fused WHERE rank <= 8")
def tool_search(t):
    """Each call ranks what its caller may read and its arguments leave."""
    docs = t.corpus.drop("text").withColumn("modified", F.timestamp_seconds("modified"))
    seen = A.visible(docs, t.principals)
    parts = [C.matching(seen.where(F.col("persona") == p), C.from_arguments(args) or {}).select(F.lit(f"call {q}").alias("persona"), F.col("doc_id").alias("id")) for q, p, _, args, _ in SEARCHES]
    rights = reduce(lambda a, b: a.union(b), parts).distinct()
    words = t.values([(q, f"call {q}", w) for q, _, text, *_ in SEARCHES for w in text.split()], "query long, persona string, term string")
    nine = lambda d: d.withColumn("score", F.round("score", 9))  # noqa: E731  so that engines order alike
    both = [S.top(nine(b), "query", "score", S.PREFETCH, "id") for b in S.search_as(words, S.term_counts(t.documents), rights)]
    r = S.top(nine(S.rrf(*both)), "query", "score", S.KEPT, "id")
    return r.select(F.col("query").alias("call"), "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
