"""Queries of access control and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import conditions as C
from .base import CORPUS_SQL, PRINCIPALS_SQL, query

_GRANT = "(list_contains(allowed_users, usr) OR len(allowed_groups) + len(allowed_roles) + len(allowed_users) = 0 OR list_has_any(allowed_groups, grps) OR list_has_any(allowed_roles, roles))"
RULE_SQL = f"tenant_id = tenant AND classification_rank <= clearance AND NOT list_contains(denied_users, usr) AND {_GRANT}"
VISIBLE_SQL = f"WITH {CORPUS_SQL}, {PRINCIPALS_SQL}, visible AS (SELECT * FROM corpus JOIN principals ON {RULE_SQL} AND NOT is_deleted)"


@query("acl_filter", f"{VISIBLE_SQL} SELECT persona, doc_id FROM visible")
def acl_filter(t):
    return A.visible(t.corpus, t.principals).select("persona", "doc_id")


@query("acl_permits", f"WITH {CORPUS_SQL}, {PRINCIPALS_SQL} SELECT persona, count(*) FILTER (WHERE {RULE_SQL}) AS permitted, 0 AS disagreements FROM corpus CROSS JOIN principals GROUP BY persona")
def acl_permits(t):
    """Both forms of the rule over every row and principal (a stated query set): they never disagree."""
    args = [F.col(x) for x in ("tenant", "user", "roles", "groups", "clearance")]
    both = t.corpus.join(F.broadcast(t.principals)).select("persona", A.acl_filter(*args, include_deleted=True).alias("a"), A.permits(*args).alias("b"))
    return both.groupBy("persona").agg(F.sum(F.col("b").cast("long")).alias("permitted"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("disagreements"))


@query("acl_filter_ids", f"{VISIBLE_SQL} SELECT persona, doc_id FROM visible WHERE doc_id IN (SELECT DISTINCT l_suppkey FROM lineitem)")
def acl_filter_ids(t):
    """What of a list of ids a caller may still read: a semi join with the list."""
    ids = t.lineitem.select(F.col("l_suppkey").alias("doc_id"))
    return A.visible(t.corpus, t.principals).join(ids, "doc_id", "left_semi").select("persona", "doc_id")


FACETS = A.Facets(doc_types=("policy", "faq", "email"), langs=("en", "de"), modified_from=1704067200 + 36000, modified_to=1704067200 + 3600 * 700)


@query("facet_filter", f"WITH {CORPUS_SQL} SELECT doc_id, doc_type, lang FROM corpus WHERE doc_type IN ('policy', 'faq', 'email') AND lang IN ('en', 'de') AND modified BETWEEN 1704103200 AND 1706587200")
def facet_filter(t):
    return t.corpus.where(FACETS.column()).select("doc_id", "doc_type", "lang")


@query("filter_intersect", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE doc_type = 'faq' AND lang = 'en' AND modified BETWEEN 1704103200 AND 1706587200 AND classification_rank <= 1")
def filter_intersect(t):
    both = FACETS & A.Facets(doc_types=("faq", "note"), langs=("en", "fr"), modified_from=0, max_rank=1)
    return t.corpus.where(both.column()).select("doc_id")


@query("filter_fill", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE doc_type = 'note' AND lang = 'fr'")
def filter_fill(t):
    return t.corpus.where(A.Facets(doc_types=("note",)).filled_by(A.Facets(doc_types=("faq",), langs=("fr",), modified_from=9, modified_to=1)).column()).select("doc_id")


@query("clearance_ceiling", f"WITH {CORPUS_SQL}, {PRINCIPALS_SQL} SELECT persona, least(clearance, 2) AS ceiling, count(*) AS readable FROM principals JOIN corpus ON tenant_id = tenant AND classification_rank <= least(clearance, 2) GROUP BY ALL")
def clearance_ceiling(t):
    p = t.principals.withColumn("ceiling", F.least("clearance", F.lit(2)))
    return t.corpus.join(p, (F.col("tenant_id") == F.col("tenant")) & (F.col("classification_rank") <= F.col("ceiling"))).groupBy("persona", "ceiling").agg(F.count(F.lit(1)).alias("readable"))


@query("tenant_filter", f"WITH {CORPUS_SQL} SELECT tenant_id, doc_id FROM corpus WHERE tenant_id IN ('src1', 'src2') AND is_deleted AND doc_id NOT IN (17, 34)")
def tenant_filter(t):
    tree = {"must": [{"key": "tenant_id", "match": {"any": ["src1", "src2"]}}, {"key": "is_deleted", "match": {"value": True}}], "must_not": [{"has_id": [17, 34]}]}
    return C.matching(t.corpus, tree).select("tenant_id", "doc_id")


@query("effective_at", f"WITH {CORPUS_SQL}, d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE modified END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE modified + 86400 * (doc_id % 30) END AS b FROM corpus) SELECT doc_id FROM d WHERE (a IS NULL OR a <= 1706000000) AND (b IS NULL OR 1706000000 < b)")
def effective_at(t):
    i = F.col("doc_id")
    d = t.corpus.select("doc_id", F.when(i % 4 != 0, F.col("modified")).alias("a"), F.when(i % 5 != 0, F.col("modified") + 86400 * (i % 30)).alias("b"))
    return d.where(A.effective_at("a", "b", F.lit(1706000000))).select("doc_id")


@query("recency_at", f"WITH {CORPUS_SQL} SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 1 THEN modified + 5 END, CASE WHEN doc_id % 3 = 1 THEN modified END, 1700000000) AS recency FROM corpus")
def recency_at(t):
    i = F.col("doc_id")
    return t.corpus.select("doc_id", F.coalesce(F.when(i % 4 == 1, F.col("modified") + 5), F.when(i % 3 == 1, F.col("modified")), F.lit(1700000000).cast("long")).alias("recency"))


_MERGE_SQL = f"""WITH {CORPUS_SQL} SELECT doc_id,
 array_to_string(CASE WHEN len(allowed_groups) + len(allowed_roles) + len(allowed_users) = 0 THEN ['g0'] ELSE allowed_groups END, ',') AS groups,
 array_to_string(CASE WHEN len(allowed_groups) + len(allowed_roles) + len(allowed_users) = 0 THEN ['user'] ELSE allowed_roles END, ',') AS roles,
 array_to_string(allowed_users, ',') AS users,
 array_to_string(list_sort(list_distinct(list_concat(denied_users, ['u9']))), ',') AS denied, greatest(classification_rank, 1) AS rank FROM corpus"""


@query("acl_merge", _MERGE_SQL)
def acl_merge(t):
    c = t.corpus.select(
        "doc_id", F.col("allowed_groups").alias("item_groups"), F.col("allowed_roles").alias("item_roles"), F.col("allowed_users").alias("item_users"), F.col("denied_users").alias("item_denied"), F.col("classification_rank").alias("item_rank"),
        F.array(F.lit("g0")).alias("base_groups"), F.array(F.lit("user")).alias("base_roles"), F.array().cast("array<string>").alias("base_users"), F.array(F.lit("u9")).alias("base_denied"), F.lit(1).alias("base_rank"),
    )
    return c.select("doc_id", *A.merge_acl()).select("doc_id", *(F.array_join(x, ",").alias(x) for x in ("groups", "roles", "users", "denied")), F.col("rank").cast("long").alias("rank"))


@query("acl_defaults", f"WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN len(allowed_groups) > 0 THEN allowed_groups[1] ELSE 'g0' END AS grp FROM corpus")
def acl_defaults(t):
    return t.corpus.select("doc_id", F.coalesce(F.try_element_at("allowed_groups", F.lit(1)), F.lit("g0")).alias("grp"))


@query("acl_parse_list", "SELECT n_nationkey, array_to_string(list_distinct_ordered, ',') AS ids FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ['a', n_name] WHEN 1 THEN ['x', n_name, 'y'] ELSE [n_name] END AS list_distinct_ordered FROM nation)")
def acl_parse_list(t):
    k, n = F.col("n_nationkey"), F.col("n_name")
    raw = F.when(k % 3 == 0, F.concat(F.lit('["a", "'), n, F.lit('", "a"]'))).when(k % 3 == 1, F.concat(F.lit(" x; "), n, F.lit(" | y,,x"))).otherwise(F.concat(n, F.lit(" , "), n))
    return t.nation.select("n_nationkey", F.array_join(A.parse_list(raw), ",").alias("ids"))


@query("acl_fingerprint", f"WITH {CORPUS_SQL} SELECT doc_id, sha256(tenant_id || '|' || array_to_string(list_sort(allowed_groups), ',') || '|' || array_to_string(list_sort(allowed_roles), ',') || '|' || array_to_string(list_sort(allowed_users), ',') || '|' || array_to_string(list_sort(denied_users), ',') || '|' || classification_rank) AS fingerprint FROM corpus")
def acl_fingerprint(t):
    return t.corpus.select("doc_id", A.acl_fingerprint().alias("fingerprint"))


@query("filter_fingerprint", f"WITH {CORPUS_SQL} SELECT tenant_id, classification_rank, count(*) AS documents, substr(sha256('1|' || tenant_id || '|' || classification_rank || '|doc_type=email,faq,policy|lang=de,en|from=1704103200|to=1706587200'), 1, 32) AS fingerprint FROM corpus GROUP BY ALL")
def filter_fingerprint(t):
    """One filter as asked by callers of every tenant and clearance that the corpus has."""
    g = t.corpus.groupBy("tenant_id", "classification_rank").agg(F.count(F.lit(1)).alias("documents"))
    return g.withColumn("fingerprint", A.filter_fingerprint(FACETS, F.col("tenant_id"), F.col("classification_rank")))


@query("doc_list", f"{VISIBLE_SQL} SELECT persona, doc_id, rn AS place FROM (SELECT persona, doc_id, row_number() OVER (PARTITION BY persona ORDER BY modified DESC, doc_id) AS rn FROM visible WHERE doc_type IN ('policy', 'faq') AND contains(lower(text), 'the')) WHERE rn <= 25")
def doc_list(t):
    """A caller's newest documents whose text has a term: a top-k report."""
    from pyspark.sql import Window

    w = Window.partitionBy("persona").orderBy(F.desc("modified"), "doc_id")
    v = A.visible(t.corpus, t.principals).where(F.col("doc_type").isin("policy", "faq") & F.col("text").ilike("%the%"))
    return v.select("persona", "doc_id", F.row_number().over(w).alias("place")).where("place <= 25")


@query("coverage", f"{VISIBLE_SQL} SELECT persona, doc_type, count(*) AS n, count(DISTINCT tenant_id) AS tenants FROM visible GROUP BY ALL")
def coverage(t):
    return A.visible(t.corpus, t.principals).groupBy("persona", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tenant_id").alias("tenants"))


@query("fx_visible", f"{VISIBLE_SQL} SELECT persona, count(*) AS n FROM visible GROUP BY persona")
def fx_visible(t):
    return A.visible(t.corpus, t.principals).groupBy("persona").agg(F.count(F.lit(1)).alias("n"))


@query("fx_canaries", f"{VISIBLE_SQL} SELECT p.persona, 'canary-' || c.doc_id AS canary FROM corpus c JOIN principals p ON c.tenant_id = p.tenant ANTI JOIN visible v ON v.persona = p.persona AND v.doc_id = c.doc_id WHERE NOT c.is_deleted")
def fx_canaries(t):
    """Tokens of the documents of a caller's tenant that the caller may not read."""
    own = t.corpus.where("not is_deleted").join(t.principals.select("persona", "tenant"), F.col("tenant_id") == F.col("tenant")).select("persona", "doc_id")
    return own.join(A.visible(t.corpus, t.principals).select("persona", "doc_id"), ["persona", "doc_id"], "left_anti").select("persona", F.concat(F.lit("canary-"), F.col("doc_id").cast("string")).alias("canary"))


#: Filters as callers send them, each with what it says in SQL.
TREES = [
    ({"must": [{"key": "lang", "match": {"value": "en"}}, {"key": "n_chars", "range": {"gte": 500, "lt": 4000}}], "must_not": [{"key": "doc_type", "match": {"any": ["email", "note"]}}]}, "lang = 'en' AND n_chars >= 500 AND n_chars < 4000 AND doc_type NOT IN ('email', 'note')"),
    ({"should": [{"key": "allowed_groups", "match": {"any": ["g1", "g2"]}}, {"is_empty": "allowed_groups"}], "must_not": [{"key": "denied_users", "match": {"value": "u2"}}, {"key": "is_deleted", "match": {"value": True}}]}, "(list_has_any(allowed_groups, ['g1', 'g2']) OR len(allowed_groups) = 0) AND NOT list_contains(denied_users, 'u2') AND NOT is_deleted"),
    ({"must": [{"should": [{"has_id": list(range(0, 400, 3))}, {"key": "classification_rank", "range": {"gt": 2}}]}, {"key": "tenant_id", "match": {"except": ["src3"]}}], "must_not": [{"must": [{"key": "lang", "match": {"value": "de"}}, {"key": "n_chars", "range": {"lte": 1000}}]}]}, "((doc_id < 400 AND doc_id % 3 = 0) OR classification_rank > 2) AND tenant_id <> 'src3' AND NOT (lang = 'de' AND n_chars <= 1000)"),
    ({"must": [{"key": "lang", "match": {"value": 5}}]}, "false"),
]
_TREE_SQL = " UNION ALL ".join(f"SELECT {k} AS tree, doc_id FROM corpus WHERE {sql}" for k, (_, sql) in enumerate(TREES))


@query("harness_match", f"WITH {CORPUS_SQL} {_TREE_SQL}")
def harness_match(t):
    """Each filter as one predicate over the corpus."""
    parts = [C.matching(t.corpus, tree).select(F.lit(k).alias("tree"), "doc_id") for k, (tree, _) in enumerate(TREES)]
    return reduce(lambda a, b: a.union(b), parts)


#: Arguments of search calls, each with what its caller may search, and what both say in SQL.
CALLS = [
    ({"doc_types": ["policy", "faq"], "languages": ["en"], "date_from": "2024-01-05"}, {"must": [{"key": "tenant_id", "match": {"value": "src1"}}]}, "tenant_id = 'src1' AND doc_type IN ('policy', 'faq') AND lang = 'en' AND modified >= 1704412800"),
    ({"doc_types": [], "languages": "en", "date_to": "2024-01-03T12:00:00Z", "date_from": "yesterday"}, None, "modified <= 1704283200"),
    ({"languages": ["de", "fr"]}, {"must": [{"key": "lang", "match": {"value": "de"}}]}, "lang = 'de'"),
]
_CALL_SQL = " UNION ALL ".join(f"SELECT {k} AS call, doc_id FROM corpus WHERE {sql}" for k, (*_, sql) in enumerate(CALLS))


@query("tool_filter", f"WITH {CORPUS_SQL} {_CALL_SQL}")
def tool_filter(t):
    """What the arguments of each call leave of what its caller may search."""
    docs = t.corpus.withColumn("modified", F.timestamp_seconds("modified"))
    trees = [C.from_arguments(args, base=base) for args, base, _ in CALLS]
    parts = [C.matching(docs, tree or {}).select(F.lit(k).alias("call"), "doc_id") for k, tree in enumerate(trees)]
    return reduce(lambda a, b: a.union(b), parts)
