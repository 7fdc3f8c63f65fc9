"""Queries of citations: answers made of what the documents say, checked against those documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as A
from ..operators import citations as C
from ..operators import output as O
from ..operators.graph import cut, spread
from .base import query, strings
from .memory import turns


def told(t):
    """(answer_id, answer): what each document opens with, a quotation of the next one, a sentence that nothing supports, and numbers without a source."""
    d = t.documents.select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    opening, quoted = F.regexp_extract("text", r"^[^.\n]{0,200}", 0), F.coalesce(F.regexp_replace(F.col("next").substr(40, 80), '["\\[\\]\\n]', " "), F.lit(""))
    end = F.when(F.col("doc_id") % 3 == 0, " None of this was ever said by 4711 people [1].").when(F.col("doc_id") % 3 == 1, " It was told by many others elsewhere [7].").otherwise("")
    answer = F.concat(opening, F.lit(' [1]. It says "'), quoted, F.lit('" [2]. '), F.reverse(opening), F.lit(" [1, 2]."), end)
    return spread(d.join(after, "doc_id", "left").select(F.col("doc_id").alias("answer_id"), answer.alias("answer")))


def printed(t):
    """(answer_id, number, source_id, text): the document itself as source 1, the next as source 2."""
    d = t.documents
    one = d.select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("number"), F.col("doc_id").alias("source_id"), "text")
    return one.union(d.select(F.col("doc_id") - 1, F.lit(2), "doc_id", "text"))


def marks(t, answers=None):
    """Answers as read and their markers as checked, each written once: what follows uses both more than once."""
    parsed = cut(C.read_answers(told(t) if answers is None else answers))
    return parsed, cut(C.checked(parsed, printed(t)))


@query("cite_extract")
def cite_extract(t):
    """Every marker of every answer: kept with its place in the source, or dropped with a reason."""
    m = marks(t)[1]
    best = C.citations(m).select("answer_id", "k", F.lit(True).alias("best"))
    out = m.join(best, ["answer_id", "k"], "left")
    return out.select("answer_id", "number", "k", "source_id", "reason", "start", "end", "ratio", F.md5("quoted").alias("digest"), F.coalesce("best", F.lit(False)).alias("best"))


@query("cite_report")
def cite_report(t):
    r = C.report(*marks(t))
    return r.withColumn("cleaned", F.md5("cleaned"))


@query("ev_validity")
def ev_validity(t):
    """The share of an answer's markers that their sources support."""
    return C.report(*marks(t)).select("answer_id", "validity")


@query("cite_windows")
def cite_windows(t):
    """The middle of each document as a claim on the document before it and on itself."""
    d = t.documents
    claim = F.col("text").substr((F.length("text") / 2).cast("int"), F.lit(120))
    own = d.select((2 * F.col("doc_id")).alias("id"), claim.alias("claim"), F.col("text").alias("source"))
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source"))
    other = d.select("doc_id", claim.alias("claim")).join(before, "doc_id").select((2 * F.col("doc_id") + 1).alias("id"), "claim", "source")
    return C.best_windows(spread(own.union(other))).select("id", "n", F.round("share", 6).alias("share"), "start", "end", F.round("ratio", 6).alias("ratio"))


def callers(t):
    """Each answer with the one who asked: of the document's tenant and group, with a clearance that is too low for some."""
    i = F.col("answer_id")
    answers = told(t).withColumn("answer", F.when(i % 6 == 1, "Sorry, no.").when(i % 6 == 2, F.concat("answer", F.lit(" Write to jane.doe@example.com."))).otherwise(F.col("answer")))
    who = t.documents.select(F.col("doc_id").alias("answer_id"), F.col("source").alias("tenant"), F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string")).alias("user"), strings("user", "auditor").alias("roles"), F.array(F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string"))).alias("groups"), (F.lit(3) - F.col("doc_id") % 5 % 4).cast("int").alias("clearance"))
    grounded = C.report(*marks(t, answers)).select("answer_id", "groundedness")
    return answers.join(who, "answer_id").join(grounded, "answer_id")


@query("output_guard")
def output_guard(t):
    """What becomes of each answer for the one who asked."""
    access = t.corpus.select(F.col("doc_id").alias("source_id"), "tenant_id", "classification_rank", "allowed_groups", "allowed_roles", "allowed_users", "denied_users")
    sources = printed(t).where("number = 1 OR answer_id % 7 = 0").join(access, "source_id").withColumn("cited", F.col("number") == 1)
    g = O.output_guard(callers(t), sources)
    return g.select("answer_id", "action", F.md5("text").alias("text"), F.md5("stored").alias("stored"), F.array_join("reasons", ",").alias("reasons"), "groundedness", F.col("lost_citations").cast("long").alias("lost_citations"))


@query("ctx_assemble")
def ctx_assemble(t):
    """A prompt for each conversation: its turns, those of the next one as sources, and of the one after as memory lines."""
    c = cut(turns(t).select("conv_id", "turn", "tokens", "pinned"))  # texts are read and measured once
    asked = c.groupBy(F.col("conv_id").alias("grp")).agg(F.lit(60).alias("fixed"), (F.max("turn") % 3 * 15).cast("long").alias("summary"))
    own = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), "tokens", "pinned")
    sources = c.select((F.col("conv_id") - 1).alias("grp"), F.col("turn").alias("id"), "tokens", (F.col("turn") % 4 / 2).alias("value")).join(asked.select("grp"), "grp")
    memories = c.select((F.col("conv_id") - 2).alias("grp"), F.col("turn").alias("id"), F.col("turn").alias("pos"), F.least("tokens", F.lit(12)).alias("tokens")).join(asked.select("grp"), "grp")
    return A.assemble(asked, own, sources, memories, 700, 100)["stats"]
