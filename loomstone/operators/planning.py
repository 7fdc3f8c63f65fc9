"""A model's answer as a retrieval plan: untrusted JSON, read field by field, bounded and cleaned, never an error.

The text is parsed once to a variant.  Each field is taken from it with a cast that
gives null where the type is wrong, so a bad field costs itself and nothing else; an
element of a list that is no text, number or truth value is left out of it.  What
cannot be parsed, or is no object, gives the plan of the bare message, marked
``degraded``; what follows an object is not looked at.  All is column functions over any number of answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_abstract, let

#: Fixed: bounds of a plan, and the kinds of sources.
MOST_QUESTIONS, MOST_HINTS, PASSAGE_CHARS, INTENT_CHARS = 3, 4, 1200, 200
FLAGS = ("needs_retrieval", "needs_tools", "is_out_of_domain")
SPACE = r"\s"


@dataclass(frozen=True)
class Vocabulary:
    """The values that closed facets may have, in lower case."""

    doc_types: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def text_at(v: Column, field: str) -> Column:
    """A text field, stripped; empty where it is missing or of another type."""
    raw = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
    return F.coalesce(stripped(raw), F.lit(""))


def texts_at(v: Column, field: str) -> Column:
    """A list field as stripped texts that are not empty, of equal ones (in any case) the first."""
    each = F.try_variant_get(v, f"$.{field}", "array<variant>")
    plain = F.transform(F.coalesce(each, F.array().cast("array<variant>")), lambda x: F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"), stripped(F.try_variant_get(x, "$", "string"))))
    return firsts(F.filter(plain, lambda x: x.isNotNull() & (x != "")))


def firsts(c: Column) -> Column:
    """The elements of a list of texts without those that an earlier one equals in any case."""
    return let(c, lambda a: let(F.transform(a, F.lower), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def within(c: Column, allowed: tuple[str, ...]) -> Column:
    """Elements of a closed vocabulary, in lower case."""
    return F.filter(F.transform(c, F.lower), lambda x: x.isin(*allowed) if allowed else F.lit(False))


def bound(c: Column, end: bool) -> Column:
    """A date of a year, a month, a day or a time; the end of a year is its last second, of a month the first instant of the next, of a day its last second."""
    as_time = lambda pattern, value=c: F.try_to_timestamp(value, F.lit(pattern))
    year, month = as_time("yyyy"), as_time("yyyy-MM")
    day = F.coalesce(as_time("yyyy-MM-dd"), as_time("yyyy/MM/dd"))
    last_second = F.expr("INTERVAL 1 SECOND")
    if end:
        year, month = year + F.expr("INTERVAL 1 YEAR") - last_second, month + F.expr("INTERVAL 1 MONTH")
        slashed = as_time("yyyy/MM/dd") + F.expr("INTERVAL 1 DAY") - last_second
        day = F.coalesce(as_time("yyyy-MM-dd"), slashed)
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}){1,2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"), c.try_cast("timestamp"))
    return F.when(c.rlike(r"^\d{4}$"), year).when(c.rlike(r"^\d{4}-\d{2}$"), month).when(c.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$"), day).otherwise(iso)


def plan(answers: DataFrame, message: str = "message", payload: str = "payload", vocabulary: Vocabulary = Vocabulary(), rewrite: bool = True, passages: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One plan per row of messages and a model's answers to them: the kept columns and intent, flags, tool_hints, rewritten, sub_questions, hyde_passage, facets, dates, confidence and degraded."""
    own = stripped(F.coalesce(F.col(message), F.lit("")))
    d = answers.select(*keep, own.alias("_message"), F.try_parse_json(F.col(payload)).alias("_v"))
    ok = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    v = F.when(ok, F.col("_v"))
    said = text_at(v, "rewritten") if rewrite else F.lit("")
    # Fields that others depend on come first, each computed once.
    d = d.select(*keep, "_message", v.alias("_v"), (~ok).alias("degraded"), F.when(said != "", said).otherwise(F.col("_message")).alias("rewritten"))
    v = F.col("_v")
    questions = F.slice(F.filter(texts_at(v, "sub_questions"), lambda x: F.lower(x) != F.lower("rewritten")), 1, MOST_QUESTIONS)
    passage = F.when(is_abstract("rewritten"), F.substring(text_at(v, "hyde_passage"), 1, PASSAGE_CHARS)).otherwise("") if passages else F.lit("")
    raw = F.try_variant_get(v, "$.confidence", "double")
    confidence = F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    # What the answer leaves open is looked up, unless there is nothing to look for.
    default = {"needs_retrieval": ~F.col("degraded") | (F.col("_message") != "")}
    flags = [F.coalesce(F.try_variant_get(v, f"$.{x}", "boolean"), default.get(x, F.lit(False))).alias(x) for x in FLAGS]
    d = d.select(
        *keep, F.substring(text_at(v, "intent"), 1, INTENT_CHARS).alias("intent"), *flags, F.slice(texts_at(v, "tool_hints"), 1, MOST_HINTS).alias("tool_hints"), "rewritten", questions.alias("sub_questions"), passage.alias("hyde_passage"),
        within(texts_at(v, "filter_doc_types"), vocabulary.doc_types).alias("doc_types"), within(texts_at(v, "filter_source_types"), vocabulary.source_types).alias("source_types"),
        *(texts_at(v, f"filter_{x}").alias(x) for x in ("tags", "authors", "languages")), text_at(v, "filter_section").alias("section"),
        bound(text_at(v, "filter_date_from"), False).alias("date_from"), bound(text_at(v, "filter_date_to"), True).alias("date_to"), confidence.alias("confidence"), "degraded",
    )
    inverted = F.coalesce(F.col("date_from") > F.col("date_to"), F.lit(False))
    open_ = {x: F.when(~inverted, F.col(x)) for x in ("date_from", "date_to")}
    return d.withColumns(open_)


def transform(messages: DataFrame, ask: Callable[[Sequence[str]], Sequence[str | None]] | None = None, message: str = "message", keep: tuple[str, ...] = (), batch: int = 32, **options) -> DataFrame:
    """The plans of messages: a model's answers where there is one, read as ``plan`` does.

    ``ask`` takes messages and gives an answer for each.  A call that fails, or gives
    another number of answers, leaves its messages without one; nothing is raised, for
    a plan of the bare message is better than no turn.
    """

    def answers(texts: list[str]) -> list[str | None]:
        try:
            found = list(ask(texts))
        except Exception:  # noqa: BLE001  whatever a model's client raises
            return [None] * len(texts)
        return found if len(found) == len(texts) else [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x or "" for x in pdf[message]]
            yield pdf.assign(payload=[a for at in range(0, len(texts), batch) for a in answers(texts[at : at + batch])])

    m = messages.select(*keep, message)
    schema = ", ".join(f"`{c}` {t}" for c, t in m.dtypes) + ", payload string"
    asked = m.withColumn("payload", F.lit(None).cast("string")) if ask is None else m.mapInPandas(run, schema)
    return plan(asked, message, "payload", keep=keep, **options)
