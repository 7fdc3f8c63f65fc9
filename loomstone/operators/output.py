"""What may leave: answers held against refusal quality, the caller's clearance, personal data and groundedness, in that order.

``output_guard`` takes any number of answers at once.  A block replaces the text and
ends what comes after it, but for the record; what is written down has its personal
data redacted whatever was emitted.

Defined results: a null answer is an empty one; an answer without sources is not held
to groundedness; an unmeasured groundedness counts as 0 where sources were given and as
not applicable where none were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pii
from .access import permits
from .guardrails import answer_leaks

#: Fixed: floors of groundedness, below which an answer is withheld and below which it carries a notice.
WITHHELD, UNCERTAIN = 0.2, 0.6
NOTICE = "Note: parts of this answer could not be verified against the sources."
BLOCKED = {"clearance": "This answer was withheld because of the classification of its sources.", "pii": "This answer was withheld because it had personal data.", "groundedness": "No answer could be supported by the sources."}
REFUSES, HELPS = "sorry|cannot|can't|not able|unable|no information|do not have", "try|contact|instead|document|ask|covered"


def refusal(text: Column) -> tuple[Column, Column]:
    """Whether a text declines to answer, and whether it then says where to go on."""
    low = F.lower(text)
    refuses = (F.length(text) <= 600) & low.rlike(REFUSES)
    return refuses, (F.length(text) >= 40) & low.rlike(HELPS)


def clearance_violations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, source_id, kind) of sources that the caller may not read: given to the model (``chunk``), cited, or told in the answer (``span``).

    ``answers`` has (answer_id, answer, tenant, user, roles, groups, clearance);
    ``sources`` has (answer_id, source_id, text, cited) and the access columns.
    """
    j = sources.join(answers, "answer_id")
    over = j.where(~F.coalesce(permits(F.col("tenant"), F.col("user"), F.col("roles"), F.col("groups"), F.col("clearance")), F.lit(False)))
    kinds = F.array(F.lit("chunk"), F.when(F.coalesce("cited", F.lit(False)), "citation"), F.when(answer_leaks(F.coalesce("answer", F.lit("")), F.coalesce("text", F.lit(""))), "span"))
    return over.select("answer_id", "source_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def output_guard(answers: DataFrame, sources: DataFrame, ignore: Sequence[str] = (), block_pii: bool = False, enforce: bool = True, withheld: float = WITHHELD, uncertain: float = UNCERTAIN) -> DataFrame:
    """answer_id, action, text (to emit), stored (to write down), reasons, pii_types, groundedness and lost_citations of every answer.

    ``answers`` has a ``groundedness`` beside the columns of ``clearance_violations``.
    """
    text = F.coalesce("answer", F.lit(""))
    bad = clearance_violations(answers, sources).groupBy("answer_id").agg(F.array_sort(F.collect_set("kind")).alias("violations"), F.count_if(F.col("kind") == "citation").alias("lost"))
    given = sources.groupBy("answer_id").agg(F.count(F.lit(1)).alias("sources"))
    found = pii.scan(answers.select(F.col("answer_id"), text.alias("t")), "answer_id", "t", "mask").select(F.col("id").alias("answer_id"), F.array_except("kinds", F.array(*map(F.lit, ignore)).cast("array<string>")).alias("pii_types"), F.col("redacted"), F.col("kinds").alias("all_kinds"))
    j = answers.select("answer_id", text.alias("answer"), "groundedness").join(bad, "answer_id", "left").join(given, "answer_id", "left").join(found, "answer_id", "left")
    refuses, helps = refusal(F.col("answer"))
    over = F.coalesce(F.size("violations") > 0, F.lit(False))
    personal = F.size(F.coalesce("pii_types", F.array().cast("array<string>"))) > 0
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("groundedness", F.lit(0.0))))
    applies = (F.coalesce("sources", F.lit(0)) > 0) & ~refuses
    j = j.select("*", refuses.alias("refuses"), helps.alias("helps"), over.alias("over"), personal.alias("personal"), held.alias("held"), applies.alias("applies"))
    stop = F.when(F.col("over") & F.lit(enforce), "clearance").when(F.col("personal") & F.lit(block_pii), "pii").when(F.col("applies") & (F.col("held") < withheld), "groundedness")
    j = j.withColumn("stop", stop).withColumn("doubt", F.col("stop").isNull() & F.col("applies") & (F.col("held") < uncertain))
    # Kinds that are let out on purpose are masked in what is written down only.
    out = F.when(F.col("personal"), F.col("redacted")).otherwise(F.col("answer"))
    noted = lambda c: F.when(F.col("doubt") & ~F.contains(c, F.lit(NOTICE)), F.concat(F.rtrim(c), F.lit(f"\n\n{NOTICE}"))).otherwise(c)
    canned = F.create_map(*(F.lit(x) for kv in BLOCKED.items() for x in kv))[F.col("stop")]
    action = F.when(F.col("stop").isNotNull(), "block").when(F.col("personal"), "redact").when(F.col("doubt"), "warn").otherwise("allow")
    reached = F.col("stop").isNull() | (F.col("stop") != "clearance")
    reasons = F.array(
        F.when(F.col("refuses") & ~F.col("helps"), "refusal:unhelpful"),
        F.when(F.col("over"), F.concat(F.lit("classification:"), F.array_join("violations", "+"))),
        F.when(F.col("personal") & reached, F.concat(F.lit("pii:"), F.array_join("pii_types", "+"))),
        F.when((F.col("stop") == "groundedness") | F.col("doubt"), F.concat(F.lit("groundedness:"), F.format_string("%.2f", F.col("held")))),
    )
    return j.select(
        "answer_id", action.alias("action"), F.coalesce(canned, noted(out)).alias("text"), F.coalesce(canned, noted(F.coalesce("redacted", F.col("answer")))).alias("stored"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"),
        F.when(reached, F.col("pii_types")).otherwise(F.array().cast("array<string>")).alias("pii_types"), F.when(F.col("applies"), F.col("held")).alias("groundedness"), F.when(F.lit(enforce), F.coalesce("lost", F.lit(0))).otherwise(0).alias("lost_citations"),
    )
