"""Queries of resolution, enrichment, rendering, screening and small checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access as A
from ..operators import citations as C
from ..operators import fingerprints as P
from ..operators import embedding as M
from ..operators import enrich as N
from ..operators import folds as D
from ..operators import guardrails as G
from ..operators import parsing as R
from ..operators import pii, tools
from .access import VISIBLE_SQL
from .base import CORPUS_SQL, query
from .delta import CLASSIFY_SQL, decided
from .guard import TURNS_SQL, answers, turns
from .text import _SIM_SQL, NORM_SQL

_DUP_SQL = f"""WITH {_SIM_SQL}, d AS (SELECT doc_id, source, {NORM_SQL} AS norm FROM documents), k AS (SELECT d.*, simhash, row_number() OVER (PARTITION BY source, norm ORDER BY doc_id) > 1 AS dup FROM d LEFT JOIN f ON f.id = doc_id)
SELECT doc_id, CASE WHEN dup THEN 'exact_duplicate' END AS dropped_reason, CASE WHEN dup THEN NULL WHEN EXISTS (SELECT 1 FROM k e WHERE NOT e.dup AND e.source = k.source AND e.doc_id < k.doc_id AND e.simhash <> 0 AND k.simhash <> 0 AND bit_count(xor(e.simhash, k.simhash)) <= 3) THEN 0.35::DOUBLE ELSE 1.0 END AS novelty FROM k"""


@query("context_dup", _DUP_SQL)
def context_dup(t):
    """Copies go; close texts stay with little novelty.  Candidates meet in bands of their fingerprints."""
    d = t.documents.select("doc_id", "source", T.normal("text").alias("norm"))
    dup = F.row_number().over(Window.partitionBy("source", "norm").orderBy("doc_id")) > 1
    k = d.withColumn("dup", dup).join(P.simhash(t.documents, "doc_id", "text").withColumnRenamed("id", "doc_id"), "doc_id", "left").drop("norm")
    live = k.where("not dup and simhash <> 0").select("doc_id", "source", "simhash", F.explode(P.keys(F.col("simhash"))).alias("band"))
    near = live.alias("b").join(live.alias("a"), ["source", "band"]).where((F.col("a.doc_id") < F.col("b.doc_id")) & (T.hamming(F.col("a.simhash"), F.col("b.simhash")) <= 3)).select(F.col("b.doc_id").alias("doc_id"), F.lit(True).alias("near")).distinct()
    return k.join(near, "doc_id", "left").select("doc_id", F.when(F.col("dup"), "exact_duplicate").alias("dropped_reason"), F.when(~F.col("dup"), F.when(F.col("near"), 0.35).otherwise(1.0)).alias("novelty"))


@query("dates_effective", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS effective_from, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS effective_to FROM orders")
def dates_effective(t):
    """The first dates after words of validity; an end that is not after its start is none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 30 days")), "d MMMM yyyy")
    start, end = N.effective_dates(F.concat(F.lit("This applies. Effective from: "), day, F.lit(" and valid until "), later, F.lit(".")))
    return t.orders.select("o_orderkey", F.date_format(start, "yyyy-MM-dd").alias("effective_from"), F.date_format(end, "yyyy-MM-dd").alias("effective_to"))


@query("enrich_doc")
def enrich_doc(t):
    """Documents with dates put into some of them, enriched."""
    i = F.col("doc_id")
    text = F.concat(F.when(i % 4 == 0, F.lit("Effective from 2024-05-06, valid until 7 June 2025. ")).when(i % 4 == 1, F.lit("Valid from: 2024-05-06 until 1 May 2024. ")).otherwise(""), "text")
    e = N.enrich(t.documents.select(i, text.alias("text")))
    return e.select(F.col("id").alias("doc_id"), F.md5("text").alias("digest"), F.array_join("pii_types", ",").alias("pii_types"), "lang", F.date_format("effective_from", "yyyy-MM-dd").alias("effective_from"), F.date_format("effective_to", "yyyy-MM-dd").alias("effective_to"), F.array_join("keywords", ",").alias("keywords"))


@query("lin_record", "SELECT 'o' || o_orderkey AS subject, 'c' || o_custkey AS parent, 'import' AS operation FROM orders UNION ALL SELECT 'x', 'o1', 'merge'")
def lin_record(t):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return t.orders.select(s("o", "o_orderkey").alias("subject"), s("c", "o_custkey").alias("parent"), F.lit("import").alias("operation")).union(t.values([("x", "o1", "merge")], "subject string, parent string, operation string"))


@query("acl_resolve_blob", f"WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'sidecar' || (doc_id % 4) WHEN len(allowed_groups) > 0 THEN allowed_groups[1] ELSE 'g0' END AS grp FROM corpus")
def acl_resolve_blob(t):
    """A sidecar's list if there is one that parses, else the item's own, else the source's."""
    sidecar = t.corpus.where("doc_id % 6 = 0").select("doc_id", F.format_string('{"groups": ["sidecar%d"]}', F.col("doc_id") % 4).alias("raw"))
    groups = A.resolved(A.from_sidecar(F.col("raw"), "groups"), F.col("allowed_groups"), default=("g0",))
    return t.corpus.join(sidecar, "doc_id", "left").select("doc_id", F.element_at(groups, 1).alias("grp"))


@query("graph_item", "SELECT substr(sha256(s_nationkey || chr(0) || s_suppkey), 1, 32) AS document_id, s_suppkey % 7 = 0 AS is_deleted, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS title FROM supplier")
def graph_item(t):
    """Feed items: ids come from the stable item id, deleted ones are tombstones."""
    gone = F.col("s_suppkey") % 7 == 0
    return t.supplier.select(T.document_id(F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")).alias("document_id"), gone.alias("is_deleted"), F.when(gone, "").otherwise(F.col("s_name")).alias("title"))


@query("acl_from_map", f"WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'm' || (doc_id % 3) END AS grp FROM corpus")
def acl_from_map(t):
    """The first of several names under which a map may declare groups; nothing declared is null."""
    value = F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))
    m = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 4 == 1, F.create_map(F.lit("allowed_groups"), value)).otherwise(F.create_map(F.lit("groups"), value))
    return t.corpus.select("doc_id", F.try_element_at(A.from_map(m), F.lit(1)).alias("grp"))


@query("acl_from_sidecar", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'a,b' || (doc_id % 5) END AS grps FROM documents")
def acl_from_sidecar(t):
    raw = F.when(F.col("doc_id") % 3 == 0, "not json").otherwise(F.format_string('{"allowed_groups": ["a", "b%d", "a"]}', F.col("doc_id") % 5))
    return t.documents.select("doc_id", F.array_join(A.from_sidecar(raw), ",").alias("grps"))


@query("acl_from_metadata", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tag' ELSE 'meta' END AS grp FROM documents")
def acl_from_metadata(t):
    """Tags win over metadata."""
    meta, tags = F.create_map(F.lit("groups"), F.lit("meta")), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("groups"), F.lit("tag"))).otherwise(F.create_map(F.lit("other"), F.lit("")))
    return t.documents.select("doc_id", F.element_at(A.from_metadata(tags, meta), 1).alias("grp"))


@query("acl_from_graph", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'g' || (doc_id % 4) || ',u' || (doc_id % 3) END AS grants FROM documents")
def acl_from_graph(t):
    """Grants of permission objects: groups and users by id, numeric ids refused, an organisation-wide link lifts all."""
    raw = F.format_string('[{"group":"g%d","scope":"%s"},{"user":"u%d"},{"user":"12345"}]', F.col("doc_id") % 4, F.when(F.col("doc_id") % 10 == 0, "organization").otherwise("users"), F.col("doc_id") % 3)
    return t.documents.select("doc_id", F.array_join(A.from_permissions(raw), ",").alias("grants"))


@query("acl_resolve_graph", "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'default' ELSE 'g' || (doc_id % 4) END AS grp FROM documents")
def acl_resolve_graph(t):
    """Item permissions; where reading them failed, the source's defaults."""
    found = t.documents.where("doc_id % 8 <> 0").select("doc_id", F.concat(F.lit("g"), (F.col("doc_id") % 4).cast("string")).alias("own"))
    return t.documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("own", F.lit("default")).alias("grp"))


@query("src_cond_get", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 304 ELSE 200 END AS status FROM pages")
def src_cond_get(t):
    known = t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.md5("html")).otherwise("old").alias("etag"))
    return t.pages.join(known, "page_id").select("page_id", F.when(F.md5("html") == F.col("etag"), 304).otherwise(200).alias("status"))


@query("dry_run", f"{CLASSIFY_SQL} SELECT action, count(*) AS documents, sum(ceil(n_chars / 2000.0))::BIGINT AS chunks FROM decided WHERE action IN ('create', 'update') GROUP BY action")
def dry_run(t):
    return decided(t).where("action in ('create', 'update')").groupBy("action").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.ceil(F.col("n_chars") / 2000)).cast("long").alias("chunks"))


@query("process_docs", f"{CLASSIFY_SQL} SELECT document_id, CASE action WHEN 'delete' THEN 'tombstone' WHEN 'acl_only' THEN 'rewrite' WHEN 'skip' THEN 'none' ELSE 'index' END AS step FROM decided")
def process_docs(t):
    step = F.when(F.col("action") == "delete", "tombstone").when(F.col("action") == "acl_only", "rewrite").when(F.col("action") == "skip", "none").otherwise("index")
    return decided(t).select("document_id", step.alias("step"))


@query("chunk_payload", f"WITH {CORPUS_SQL} SELECT tenant_id, doc_id || '::' || lpad((pos - 1)::VARCHAR, 4, '0') AS chunk_id, classification_rank, md5(p) AS digest FROM (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM corpus))")
def chunk_payload(t):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    c = t.corpus.select("tenant_id", "doc_id", "classification_rank", F.posexplode(parts).alias("pos", "p"))
    return c.select("tenant_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("chunk_id"), "classification_rank", F.md5("p").alias("digest"))


@query("token_memo", "SELECT count(DISTINCT text) AS counted, count(*) AS asked FROM conversations")
def token_memo(t):
    return t.conversations.agg(F.count_distinct("text").alias("counted"), F.count(F.lit(1)).alias("asked"))


@query("conflict_notes", "SELECT source, string_agg('- ' || doc_id || ' against ' || (doc_id + 1), chr(10) ORDER BY doc_id) AS notes FROM documents GROUP BY source")
def conflict_notes(t):
    line = F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(" against "), (F.col("doc_id") + 1).cast("string"))
    g = t.documents.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("l"))
    return g.select("source", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("notes"))


@query("coverage_text", f"{VISIBLE_SQL} SELECT persona, 'I can help with ' || string_agg(DISTINCT doc_type, ', ' ORDER BY doc_type) || '.' AS refusal FROM visible GROUP BY persona")
def coverage_text(t):
    g = A.visible(t.corpus, t.principals).groupBy("persona").agg(F.array_join(F.array_sort(F.collect_set("doc_type")), ", ").alias("types"))
    return g.select("persona", F.concat(F.lit("I can help with "), "types", F.lit(".")).alias("refusal"))


@query("src_block", "SELECT conv_id, string_agg('[' || rn || '] ' || substr(text, 1, 40), chr(10) ORDER BY rn) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def src_block(t):
    r = t.conversations.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    g = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.format_string("[%d] %s", F.col("rn"), F.substring("text", 1, 40)).alias("line")))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


@query("src_render", f"WITH {TURNS_SQL} SELECT conv_id, turn, '[' || (turn + 1) || '] ' || role AS head FROM turns")
def src_render(t):
    return turns(t).select("conv_id", "turn", F.format_string("[%d] %s", F.col("turn") + 1, F.col("role")).alias("head"))


@query("cite_strip", r"SELECT conv_id, turn, md5(regexp_replace(text || ' [' || (turn % 4) || '] and [1].', ' ?\[0\]', '', 'g')) AS digest FROM conversations WHERE role = 'assistant'")
def cite_strip(t):
    a = F.format_string("%s [%d] and [1].", F.col("text"), F.col("turn") % 4)
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.md5(F.regexp_replace(a, r" ?\[0\]", "")).alias("digest"))


@query("cite_quote", """SELECT event_id, 'q' || (event_id % 7) || ' long' AS quoted FROM events""")
def cite_quote(t):
    """The longest of the quotations in a text."""
    text = F.format_string('say "q" then "q%d long" end', F.col("event_id") % 7)
    return t.events.select("event_id", C.longest_quotation(text).alias("quoted"))


@query("clearance_check", f"WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN is_deleted THEN 'deleted' WHEN classification_rank > 2 THEN 'clearance' WHEN list_contains(denied_users, 'u2') THEN 'denied' END AS violation FROM corpus WHERE is_deleted OR classification_rank > 2 OR list_contains(denied_users, 'u2')")
def clearance_check(t):
    kind = F.when(F.col("is_deleted"), "deleted").when(F.col("classification_rank") > 2, "clearance").when(F.array_contains("denied_users", "u2"), "denied")
    return t.corpus.select("doc_id", kind.alias("violation")).where("violation is not null")


@query("tool_screen", "SELECT event_id, CASE WHEN event_id % 4 > 2 THEN 'classification' WHEN contains(props, '@') THEN 'personal data' END AS refused FROM events")
def tool_screen(t):
    return t.events.select("event_id", tools.refused(F.col("event_id") % 4, 2, F.col("props")).alias("refused"))


@query("tool_dispatch", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'hidden' WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 3 THEN 'loop' WHEN event_id % 4 > 2 THEN 'screened' ELSE 'ran' END AS gate FROM events")
def tool_dispatch(t):
    """The first gate that a call fails."""
    return tools.gated(t.events, ("user_id", "event_type"), "event_id", 3, F.col("event_type") == "view", F.col("event_id") % 4 > 2).select("event_id", "gate")


@query("tool_coerce", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(json_extract_string(props, '$.limit') AS BIGINT), 10) AS lim FROM events")
def tool_coerce(t):
    return t.events.select("event_id", tools.coerced("props", "k", "long").alias("k"), tools.coerced("props", "limit", "long", 10).alias("lim"))


@query("tool_redact", """SELECT event_id, '{"token":"***","k":' || (event_id % 9) || '}' AS args FROM events""")
def tool_redact(t):
    args = F.format_string('{"token":"s%d","k":%d}', F.col("event_id"), F.col("event_id") % 9)
    return t.events.select("event_id", tools.redacted(args).alias("args"))


@query("ev_config_fp", "SELECT source, count(*) AS documents, substr(sha256('k1=1.2|b=0.75|rrf=60|index=' || source || '|size=' || count(*)), 1, 16) AS fingerprint FROM documents GROUP BY source")
def ev_config_fp(t):
    """What a run's figures depend on, the index that it ran on included: one for each source's."""
    from ..operators import evaluation as V
    from ..operators import search as S

    g = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return g.select("source", "documents", V.config_fingerprint({"k1": S.K1, "b": S.B, "rrf": S.RRF_K}, index=F.col("source"), size=F.col("documents")).alias("fingerprint"))


@query("null_sink", "SELECT count(*) AS rows FROM documents")
def null_sink(t):
    """A sink that keeps nothing takes all rows."""
    t.documents.write.format("noop").mode("overwrite").save()
    return t.documents.agg(F.count(F.lit(1)).alias("rows"))


def _python(rows, columns: str, out: str, fn):
    """Rows through a Python function of each row's values, in Arrow batches."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([fn(*r) for r in pdf.itertuples(index=False)], columns=names)

    return rows.select(*columns.split()).mapInPandas(run, out)


@query("unicode_norm")
def unicode_norm(t):
    import unicodedata

    return _python(t.conversations, "conv_id turn text", "conv_id long, turn long, text string", lambda c, n, x: (c, n, unicodedata.normalize("NFKC", x or "")))


@query("table_render", "SELECT n_nationkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || replace(trim(n_name), '|', '\\|') || ' |' || chr(10) || '| ' || replace(trim(n_name), '|', '\\|') || ' |  |' AS rendered FROM nation")
def table_render(t):
    row = lambda *x: F.array(*x).cast("array<string>")
    rows = F.array(row(F.lit("key"), F.lit("name")), row(F.col("n_nationkey").cast("string"), F.col("n_name")), row(F.lit(""), F.lit("")), row(F.col("n_name")))
    return t.nation.select("n_nationkey", T.pipe_table(rows).alias("rendered"))


@query("split_prose")
def split_prose(t):
    return _python(t.documents, "doc_id text", "doc_id long, parts long", lambda i, x: (i, len(list(R._pack(R.sentences(x or ""), R.TARGET, " ")))))


@query("overlap_tail")
def overlap_tail(t):
    return _python(t.documents, "doc_id text", "doc_id long, tail string", lambda i, x: (i, R.tail(x or "")))


@query("cite_sentences")
def cite_sentences(t):
    found = lambda x: [(m.start(), m.end()) for m in re.finditer(r"[^.!?:;\n]+[.!?:;]*", x) if m.group().strip()]
    return _python(answers(t), "conv_id turn answer", "conv_id long, turn long, n long, last long", lambda c, n, x: (c, n, len(found(x)), max((e for _, e in found(x)), default=0)))


@query("pii_analyze")
def pii_analyze(t):
    return _python(t.documents, "doc_id text", "doc_id long, n long", lambda i, x: (i, len(pii.analyse(x or ""))))


@query("pii_custom")
def pii_custom(t):
    own = {"AADHAAR", "PAN", "SWIFT_CODE", "JWT", "API_KEY"}
    return _python(t.documents, "doc_id text", "doc_id long, kinds string", lambda i, x: (i, ",".join(sorted({m[0] for m in pii.find(x or "") if m[0] in own}))))


@query("pii_pseudonym")
def pii_pseudonym(t):
    return _python(t.customer, "c_custkey c_name", "c_custkey long, token string", lambda k, n: (k, pii.pseudonym(n, "PERSON")))


@query("iban", "SELECT o_orderkey, ('32142829' || lpad(o_orderkey::VARCHAR, 14, '0') || '1611' || lpad((o_orderkey % 97)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS ok FROM orders")
def iban(t):
    """Account numbers made of order keys, of which one in 97 checks out."""
    k = F.col("o_orderkey")
    value = F.concat(F.lit("GB"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(k.cast("string"), 14, "0"))
    return t.orders.select("o_orderkey", T.iban_ok(value).alias("ok"))


def _turns() -> list[list[int]]:
    turn, out = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        out.append([turn[d] for d in out[-1]])
    return out


_VERHOEFF_SQL = f"""WITH d AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 12, '0') AS v FROM orders),
p AS (SELECT o_orderkey, list_transform(range(1, 13), lambda k: ({_turns()})[(k - 1) % 8 + 1][v[13 - k]::INT + 1]) AS t FROM d)
SELECT o_orderkey, list_reduce(list_prepend(0, t), lambda a, b: CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN (a + b - 5) % 5 + 5 WHEN b < 5 THEN (a - b) % 5 + 5 ELSE (a - b + 5) % 5 END) = 0 AS ok FROM p"""


@query("verhoeff", _VERHOEFF_SQL)
def verhoeff(t):
    return t.orders.select("o_orderkey", T.verhoeff_ok(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("ok"))


@query("quantities")
def quantities(t):
    return _python(t.documents, "doc_id text", "doc_id long, n long", lambda i, x: (i, len(D.quantities(x or ""))))


@query("input_guard")
def input_guard(t):
    """Size, then injection, then redaction: what becomes of a user's turn."""
    user = turns(t).where("role = 'user'")
    size = F.length(F.trim("text"))
    verdict = F.when(size < 2, "clarify").when(size > 50_000, "block").otherwise(G.action(G.injection_score("text")))
    scanned = pii.scan(user.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text"), "id", "text").select("id", F.size("findings").alias("redactions"))
    return user.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), verdict.alias("action")).join(scanned, "id")


@query("embed_batch")
def embed_batch(t):
    """Whole texts through the seam of a model; here words hashed to places."""
    return M.embed(t.documents).withColumnRenamed("id", "doc_id")
