"""Queries of folds: parsers, chunks, personal data, greedy choices.  SQL cannot say most of these; tests hold them to brute force."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import dispatch as X
from ..operators import fingerprints as P
from ..operators import folds as D
from ..operators import guardrails as G
from ..operators import parsing as R
from ..operators import pii
from .base import query
from .memory import memories, turns


@query("parse_markdown")
def parse_markdown(t):
    md = t.documents.select("doc_id", F.concat(F.lit("# Title\n\n"), F.col("text"), F.lit("\n\n- one\n- two\n\n```\ncode\n```\n\n| a | b |\n| - | - |\n| 1 | 2 |")).alias("md"))
    return R.blocks(md, "doc_id", "md", "markdown").select("id", "pos", "kind", F.md5("text").alias("digest"), F.array_join("section", " > ").alias("section"))


@query("parse_html")
def parse_html(t):
    return R.blocks(t.pages, "page_id", "html", "html").select("id", "pos", "kind", F.md5("text").alias("digest"), F.array_join("section", " > ").alias("section"))


@query("parse_csv")
def parse_csv(t):
    """Orders of each customer as a file of rows."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string"))
    g = t.orders.groupBy("o_custkey").agg(F.concat(F.lit("id,status,price\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("csv"))
    return R.blocks(g, "o_custkey", "csv", "csv").select("id", "pos", "kind", F.md5("text").alias("digest"))


@query("parse_dispatch")
def parse_dispatch(t):
    """Documents and pages as one feed: each row tells its parser by a media type, a file name, an address, or (documents) by nothing."""
    i, k, page = F.col("doc_id"), F.pmod("doc_id", F.lit(4)), F.pmod("page_id", F.lit(4))
    docs = t.documents.select(
        F.concat(F.lit("d"), i).alias("id"),
        F.when(F.pmod(i, F.lit(5)) == 0, F.concat(F.lit(" Document "), i)).alias("title"),
        F.when(k == 0, "Text/Plain; charset=utf-8").when(k == 3, "application/octet-stream").alias("media_type"),
        F.when(k == 1, F.concat(F.lit("a.html/note_"), i, F.lit(".TXT"))).when(k == 3, F.concat(F.lit("log-"), i)).alias("filename"),
        F.col("text").alias("content_text"),
    )
    pages = t.pages.select(
        F.concat(F.lit("p"), "page_id").alias("id"),
        F.when(page == 0, " text/HTML; charset=utf-8").when(page == 1, "application/xhtml+xml").alias("media_type"),
        F.when(page == 2, F.concat(F.lit("site/page-"), "page_id", F.lit(".HTM"))).alias("filename"),
        F.when(page == 3, F.concat(F.coalesce(F.substring_index("url", "?", 1), F.lit("")), F.lit("/index.html"))).otherwise(F.col("url")).alias("source_uri"),
        F.encode("html", "utf-8").alias("content_bytes"),
    )
    parsed = X.documents(docs.unionByName(pages, allowMissingColumns=True), "id")
    return X.blocks(parsed).groupBy("format", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("title").alias("titles"))


@query("section_path")
def section_path(t):
    return R.blocks(t.pages, "page_id", "html", "html").where("kind = 'heading'").select("id", "pos", "level", F.array_join("section", " > ").alias("section"))


@query("chunk_doc")
def chunk_doc(t):
    return R.chunks(t.documents, "doc_id", "text").select("id", "pos", F.md5("text").alias("digest"), "tokens")


@query("sentences")
def sentences(t):
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return t.documents.select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query("pii_scan")
def pii_scan(t):
    return pii.scan(t.documents, "doc_id", "text").select(F.col("id").alias("doc_id"), F.explode("findings").alias("f")).select("doc_id", "f.*")


@query("pii_redact")
def pii_redact(t):
    return pii.scan(t.documents, "doc_id", "text", "hash").select(F.col("id").alias("doc_id"), F.array_join("kinds", ",").alias("kinds"), F.sha2("redacted", 256).alias("digest"))


@query("pii_report")
def pii_report(t):
    return pii.scan(t.documents, "doc_id", "text").select(F.explode("findings").alias("f")).groupBy("f.kind").agg(F.count(F.lit(1)).alias("n"), F.max("f.score").alias("top"))


@query("dedupe_greedy")
def dedupe_greedy(t):
    """The candidate list of a query: each conversation's turns, first wins."""
    c = t.conversations.select(F.col("conv_id").alias("grp"), F.col("turn").alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return P.greedy(c, "grp", "pos", "text")


@query("ctx_pack")
def ctx_pack(t):
    s = t.conversations.select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), estimate_tokens("text").alias("tokens"))
    return D.pack_context(s.withColumn("density", F.round((1 + F.col("id") % 5) / F.greatest(F.lit(1), "tokens"), 9)), 200)


@query("ctx_history")
def ctx_history(t):
    return D.select_history(turns(t).select("conv_id", "turn", "pinned", "tokens"), 300)


@query("mem_merge")
def mem_merge(t):
    return D.merge_memories(memories(t).select("user", "id", "kind", "vector", "salience", "hits"), 0.3)


@query("cite_verify")
def cite_verify(t):
    """Each turn's text as a claim on the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.substring_index("text", ".", 1).alias("claim"), F.lag("text").over(w).alias("source"))
    return D.verify_claims(p.where("source is not null"))


@query("conflict_verdict")
def conflict_verdict(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), F.lag("text").over(w).alias("b"))
    return D.conflicts(p.where("b is not null"))


@query("claim_cluster")
def claim_cluster(t):
    """Claims joined to the least claim that they reach by likeness, however long the chain."""
    from .guard import _claims, _idf

    u = _claims(t)
    uw = u.join(_idf(u), "term").select("id", "term", "idf")
    return G.claim_classes(uw)
