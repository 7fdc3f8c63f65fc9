"""Queries of deduplication over runs, tools, prompts under pressure, and the parts of parsing and personal data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import dedupe as Q
from ..operators import folds as D
from ..operators import parsing as R
from ..operators import pii
from ..operators import tools as O
from .base import query
from .memory import TURNS_SQL, turns
from .search import _FUSED_SQL, fused


@query("dedupe_ingest")
def dedupe_ingest(t):
    """All documents as chunks of a run, against what one source has indexed."""
    d = t.documents
    return Q.ingest(d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document"), "text"), Q.by_owner(d, F.col("source") == "src0"))


@query("dedupe_retrieval")
def dedupe_retrieval(t):
    """The fused candidates of each question, best first."""
    c = fused(t).join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return Q.retrieved(c.select(F.col("query").alias("grp"), F.col("rank").alias("pos"), "id", "text"))


_ENC = "replace(url_encode({}), '+', '%20')"


@query("tool_template", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/orders/' || {_ENC.format('o_orderpriority')} || '/' || o_orderkey || '?status=' || {_ENC.format('o_orderstatus')} END AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'status' ELSE '' END AS missing FROM orders")
def tool_template(t):
    args = {"priority": F.col("o_orderpriority"), "key": F.col("o_orderkey"), "status": F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))}
    r = O.render("/orders/{priority}/{key}?status={status}", args, quote=True)
    return t.orders.select("o_orderkey", r["text"].alias("path"), F.array_join(r["missing"], ",").alias("missing"))


_SCHEMA = {"properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "mode": {"type": "string", "enum": ["a", "b"]}}, "required": ["k"]}
_ERRORS_SQL = """WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"mode": "a"}' WHEN 1 THEN '{"k": "12", "mode": "b"}' WHEN 2 THEN replace(props, '}', ', "extra": 1}') ELSE props END AS args FROM events)
SELECT event_id, array_to_string(list_sort(list_filter([
 CASE WHEN json_type(args, '$.k') IS NULL THEN 'k: required' WHEN json_type(args, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'k: expected integer' WHEN (args ->> '$.k')::BIGINT < 10 THEN 'k: below minimum 10' WHEN (args ->> '$.k')::BIGINT > 90 THEN 'k: above maximum 90' END,
 CASE WHEN json_type(args, '$.extra') IS NOT NULL THEN 'extra: not declared' END], lambda x: x IS NOT NULL)), '; ') AS errors FROM a"""


@query("tool_validate", _ERRORS_SQL)
def tool_validate(t):
    kind = F.col("event_id") % 5
    args = F.when(kind == 0, '{"mode": "a"}').when(kind == 1, '{"k": "12", "mode": "b"}').when(kind == 2, F.replace(F.col("props"), F.lit("}"), F.lit(', "extra": 1}'))).otherwise(F.col("props"))
    return t.events.select("event_id", F.array_join(O.errors(args, _SCHEMA), "; ").alias("errors"))


_LINES = "'[' || rank || '] document ' || id || CASE WHEN id % 2 = 0 THEN ' — ' || source ELSE '' END || chr(10) || '    source: doc://' || id || chr(10) || '    chunk_id: ' || id || '::0000' || chr(10) || '    ' || substr(translate(trim(text, ' '), chr(10), ' '), 1, 300)"


@query("tool_render", f"{_FUSED_SQL} SELECT query, string_agg({_LINES}, chr(10) ORDER BY rank) AS text FROM fused JOIN documents ON doc_id = id GROUP BY query")
def tool_render(t):
    r = fused(t)
    i = F.col("id").cast("string")
    d = t.documents.select(F.col("doc_id").alias("id"), "source", "text")
    hits = r.join(d, "id").select("query", "rank", F.concat(F.lit("document "), i).alias("title"), F.when(F.col("id") % 2 == 0, F.col("source")).alias("section"), F.concat(F.lit("doc://"), i).alias("uri"), F.concat(i, F.lit("::0000")).alias("chunk_id"), "text")
    return O.render_sources(r, hits)


_SHED_SQL = f"""WITH {TURNS_SQL}, i AS (SELECT conv_id AS grp, CASE WHEN role = 'system' THEN 'memory' WHEN turn % 3 = 2 THEN 'source' ELSE 'turn' END AS kind, turn AS id, (turn * 7 % 5)::DOUBLE AS value, turn AS pos, tokens, pinned FROM turns),
p AS (SELECT *, row_number() OVER (PARTITION BY grp, kind ORDER BY value, id DESC) AS weak, count(*) OVER (PARTITION BY grp, kind) AS many FROM i),
o AS (SELECT *, CASE WHEN kind = 'source' AND weak <= many - 2 THEN 1 WHEN kind = 'memory' THEN 2 WHEN kind = 'source' THEN 3 WHEN kind = 'turn' AND NOT pinned THEN 4 END AS place, CASE kind WHEN 'source' THEN weak WHEN 'memory' THEN -pos ELSE pos END AS within FROM p),
f AS (SELECT *, coalesce(sum(CASE WHEN place IS NULL THEN 0 ELSE greatest(1, tokens) END) OVER (PARTITION BY grp ORDER BY place NULLS LAST, within, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM o)
SELECT grp AS conv_id, id AS turn, place IS NOT NULL AND freed < 40 + grp % 60 AS shed FROM f"""


@query("ctx_shed", _SHED_SQL)
def ctx_shed(t):
    """Turns as sources, memory lines and history, of which each conversation has some tokens too many."""
    kind = F.when(F.col("role") == "system", "memory").when(F.col("turn") % 3 == 2, "source").otherwise("turn")
    i = turns(t).select(F.col("conv_id").alias("grp"), kind.alias("kind"), F.col("turn").alias("id"), (F.col("turn") * 7 % 5).cast("double").alias("value"), F.col("turn").alias("pos"), "tokens", "pinned")
    need = i.select("grp").distinct().withColumn("need", 40 + F.col("grp") % 60)
    return C.shed(i, need).select(F.col("grp").alias("conv_id"), F.col("id").alias("turn"), "shed")


@query("pdf_text")
def pdf_text(t):
    """Texts as if taken from pages, with a numbered heading and a list."""
    page = F.concat(F.lit("4.2 Retention\n\n"), "text", F.lit("\n\nShort Title\n\n- one\n- two"))
    return R.blocks(t.documents.select("doc_id", page.alias("page")), "doc_id", "page", "page").select("id", "pos", "kind", "level", F.md5("text").alias("digest"), F.array_join("section", " > ").alias("section"))


def _parts(rows, id_col, text_col, fn):
    """(id, pos, digest, tokens) of what ``fn`` makes of each text, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            out = [(i, k, x) for i, text in zip(pdf["id"], pdf["text"], strict=True) for k, x in enumerate(fn(text or ""))]
            yield pd.DataFrame(out, columns=["id", "pos", "text"])

    d = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, pos int, text string")
    return d.select("id", "pos", F.md5("text").alias("digest"), T.estimate_tokens("text").alias("tokens"))


@query("split_atomic")
def split_atomic(t):
    """Blocks of code that are too large are split by lines."""
    return _parts(t.documents, "doc_id", "text", lambda x: R.split_block({"kind": "code", "text": x}))


@query("table_batch")
def table_batch(t):
    """The words of a text as a table of four columns, in batches that fit a chunk."""

    def batches(x):
        w = x.split()
        return [R.table([["a", "b", "c", "d"], *rows]) for rows in R.table_batches(["a", "b", "c", "d"], [w[k : k + 4] for k in range(0, len(w), 4)])]

    return _parts(t.documents, "doc_id", "text", batches)


@query("merge_runt")
def merge_runt(t):
    """Sentences as chunks, of which a last short one joins the one before."""

    def merged(x):
        return [c["text"] for c in R.merge_runt([{"text": s, "section": [], "tokens": R.tokens(s)} for s in R.sentences(x)])]

    return _parts(t.documents, "doc_id", "text", merged)


@query("pii_find")
def pii_find(t):
    return pii.matches(t.documents, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("pii_overlap")
def pii_overlap(t):
    """How many matches of at least the threshold give way to better ones, by kind."""
    d = t.documents
    every = pii.matches(d, "doc_id", "text").where(F.col("score") >= pii.LEAST).groupBy("kind").agg(F.count(F.lit(1)).alias("found"))
    kept = pii.scan(d, "doc_id", "text").select(F.explode("findings").alias("f")).groupBy("f.kind").agg(F.count(F.lit(1)).alias("kept"))
    return every.join(kept, "kind", "left").select("kind", "found", F.coalesce("kept", F.lit(0)).alias("kept"))


_JWT_SQL = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'eyJhbGciOiJIUzI1NiJ9' WHEN 1 THEN 'eyJ0eXAiOiJKV1QifQ' WHEN 2 THEN 'eyJhbGciOiJSUzI1NiIsImtpZCI6IjEifQ' WHEN 3 THEN 'eyJub3QganNvbg' ELSE 'eyJhbGciOiJIUzI1NiJ9' END || '.' || md5(text) || CASE WHEN doc_id % 5 = 4 THEN '' ELSE '.' || substr(md5(text), 1, 8) END AS word, doc_id % 5 IN (0, 2) AS ok FROM documents"""


@query("jwt_check", _JWT_SQL)
def jwt_check(t):
    """Tokens put into the documents, found again, and whether their head says how they are signed; a word of two parts is none."""
    heads = F.array(*map(F.lit, ("eyJhbGciOiJIUzI1NiJ9", "eyJ0eXAiOiJKV1QifQ", "eyJhbGciOiJSUzI1NiIsImtpZCI6IjEifQ", "eyJub3QganNvbg", "eyJhbGciOiJIUzI1NiJ9")))
    i = F.col("doc_id")
    token = F.concat(F.element_at(heads, (i % 5 + 1).cast("int")), F.lit("."), F.md5("text"), F.when(i % 5 == 4, "").otherwise(F.concat(F.lit("."), F.substring(F.md5("text"), 1, 8))))
    text = F.concat("text", F.lit(" bearer "), token, F.lit(" ends"))
    w = t.documents.select(i, F.explode(F.regexp_extract_all(text, F.lit(r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_.-]*"), F.lit(0))).alias("word"))

    @F.pandas_udf("boolean")
    def ok(words: pd.Series) -> pd.Series:
        return words.map(pii.web_token)

    return w.select("doc_id", "word", ok("word").alias("ok"))


@query("pii_block_scan")
def pii_block_scan(t):
    """Blocks of every document redacted one by one; a document has the kinds of all its blocks."""
    b = R.blocks(t.documents, "doc_id", "text", "text").select((F.col("id") * 100_000 + F.col("pos")).alias("id"), "text")
    s = pii.scan(b, "id", "text").join(b, "id")
    g = s.groupBy(F.floor(F.col("id") / 100_000).cast("long").alias("doc_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.max(F.col("redacted") != F.col("text")).alias("redacted"))
    return g.select("doc_id", F.array_join("kinds", ",").alias("kinds"), "redacted")


@query("pii_verify")
def pii_verify(t):
    """The seam of a second look at certain findings; here it rejects those that are called an example."""
    d = t.documents
    f = pii.scan(d, "doc_id", "text").select("id", F.explode("findings").alias("f")).select("id", "f.*")
    around = F.lower(F.col("text").substr(F.greatest(F.lit(1), F.col("start") - 40), F.col("end") - F.col("start") + 80))
    rejected = f.join(d.select(F.col("doc_id").alias("id"), "text"), "id").where(F.contains(around, F.lit("example")))
    return pii.verified(f, rejected, 0.7).withColumnRenamed("id", "doc_id")


def _pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), F.lag("text").over(w).alias("b")).where("b is not null")


@query("conflict_numeric")
def conflict_numeric(t):
    """The quantity on which a turn and the one before disagree."""

    @F.pandas_udf("string")
    def key(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([D.numeric(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=object)

    return _pairs(t).select("id", key("a", "b").alias("key"))


@query("conflict_polarity")
def conflict_polarity(t):
    """Whether a turn negates a duty of the one before."""

    @F.pandas_udf("boolean")
    def opposed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([D.polarity(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return _pairs(t).select("id", opposed("a", "b").alias("opposed"))
