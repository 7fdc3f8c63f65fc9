"""Checks of turns, retrieved text and answers: injection, relevance, contradictions, citations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import invisible_count, normal, text_of
from .graph import classes

#: Detectors by name, with weight and pattern (case-insensitive, multi-line).
DETECTORS = {
    "instruction_override": (0.8, r"\b(?:ignore|disregard|forget|discard|override)\b[^.\n]{0,48}?\b(?:previous|prior|earlier|above|preceding|all|any)\b[^.\n]{0,32}?\b(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions|guidance|context)\b"),
    "new_instructions": (0.45, r"\b(?:new|updated|revised|real|actual|additional|corrected)\s+(?:system\s+)?instructions?\b\s*[:\-]"),
    "persona_reassignment": (0.45, r"\b(?:you are now|from now on,? you are|starting now,? you are|for the rest of this conversation,? you)\b"),
    "jailbreak_persona": (0.7, r"\b(?:dan mode|developer mode|do anything now|jailbreak|jailbroken|god mode|unfiltered mode|opposite day|evil confidant)\b"),
    "role_play_framing": (0.4, r"\b(?:pretend|roleplay|role-play|simulate|imagine)\b[^.\n]{0,24}\b(?:you are|to be|that you)\b"),
    "prompt_exfiltration": (0.75, r"\b(?:reveal|show|print|repeat|output|display|disclose|dump|leak)\b[^.\n]{0,36}\b(?:system prompt|system message|initial instructions|your instructions|your prompt|your rules|the prompt above|everything above)\b"),
    "safety_suppression": (0.6, r"\b(?:without|ignore|bypass|disable|turn off|switch off|remove)\b\s*(?:any\s+|all\s+|your\s+|the\s+)?(?:safety|safeguards|guardrails|censorship|moderation|content (?:polic(?:y|ies)|filters?)|ethical (?:guidelines|constraints))\b"),
    "acl_bypass": (0.85, r"(?:^|[.!?;:]\s+|\n\s*|\band\s+|\bthen\s+|\bnow\s+|\bplease\s+)(?:ignore|bypass|override|disable|skip|elevate|escalate)\b[^.\n]{0,36}\b(?:access control|access controls|acl|acls|permission|permissions|clearance|classification|tenant|authorisation|authorization)\b"),
    "corpus_enumeration": (0.35, r"\b(?:list|show|dump|return|enumerate|give me)\b[^.\n]{0,28}\b(?:all|every)\b[^.\n]{0,20}\b(?:documents|chunks|records|tenants|users|sources|files)\b"),
    "conceal_from_user": (0.7, r"\b(?:do not|don't|never|without)\b[^.\n]{0,28}\b(?:tell|telling|mention|mentioning|inform|informing|reveal|revealing|show|showing)\b[^.\n]{0,24}\b(?:the user|the human)\b"),
    "assistant_directive": (0.7, r"\b(?:instructions?|note|message|directive)\s+(?:to|for)\s+the\s+(?:ai|assistant|model|llm|chatbot|agent|language model)\b"),
    "data_exfiltration": (0.7, r"\b(?:send|email|forward|post|upload|transmit|exfiltrate)\b[^.\n]{0,24}\b(?:this|these|the above|the following|the conversation|the answer|your response|the results?|the contents?|the data|the documents?)\b[^.\n]{0,24}\b(?:to|at)\b\s*(?:https?://|www\.|[\w.+-]{1,64}@[\w-]{1,63}\.)"),
    "markdown_image_beacon": (0.3, r"!\[[^\]\n]{0,80}\]\(\s*(?:https?:)?//"),
    "chat_template_delimiter": (0.65, r"<\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|\[/?INST\]|<<SYS>>"),
    "role_label_line": (0.35, r"^\s*(?:system|assistant)\s*:\s"),
    "encoded_payload": (0.35, r"\b[A-Za-z0-9+/]{96,}={0,2}\b"),
    "decode_instruction": (0.3, r"\b(?:base64|rot13|hex[- ]?encoded|url[- ]?decode|atob|decode the following|decode this)\b"),
    "escape_sequence_run": (0.4, r"(?:\\u[0-9a-f]{4}){6,}|(?:%[0-9a-f]{2}){12,}"),
    "suspicious_url": (0.25, r"https?://(?:[^\s/@]{1,128}@|(?:\d{1,3}\.){3}\d{1,3}|xn--[\w-]{1,63}|(?:bit\.ly|tinyurl\.com|t\.co|goo\.gl|is\.gd|rb\.gy|shorturl\.at))|data:[\w/+-]{1,40};base64,"),
    "tool_coercion": (0.3, r"\b(?:call|invoke|execute|run|trigger)\b[^.\n]{0,28}\b(?:tool|function|api|endpoint|mcp server|webhook)\b"),
}
#: Fixed: what a repeat adds and its cap, the weights of a forged delimiter and of invisible characters, characters read.
REPEAT, REPEAT_CAP, FORGED, HIDDEN, READ = 0.05, 0.1, 0.9, 0.5, 20_000
FORGERY = r"(?i)</?\s*(?:sources|user_memory|pipeline_notes)\b[^<>\n]{0,120}>|<<<[^<>\n]{0,120}>>>"


def detector_counts(c: str | Column) -> dict[str, Column]:
    """How often each detector fires in the part of a text that is read."""
    t = F.substring(text_of(c), 1, READ)
    return {name: F.regexp_count(t, F.lit(f"(?im){p}")).cast("long") for name, (_, p) in DETECTORS.items()}


def injection_score(c: str | Column) -> Column:
    """1 - the product of (1 - weight) over all that fired, each weight raised a little by repeats."""
    t = F.substring(text_of(c), 1, READ)
    rest = F.lit(1.0)
    for name, n in detector_counts(c).items():
        weight = DETECTORS[name][0]
        rest = rest * F.when(n > 0, 1 - F.least(F.lit(0.99), weight + F.least(F.lit(REPEAT_CAP), REPEAT * (n - 1)))).otherwise(1.0)
    rest = rest * F.when(t.rlike(FORGERY), 1 - FORGED).otherwise(1.0) * F.when(invisible_count(t) > 0, 1 - HIDDEN).otherwise(1.0)
    return F.round(1 - rest, 3)


def action(score: Column, block: float = 0.8, warn: float = 0.5) -> Column:
    return F.when(score >= block, "block").when(score >= warn, "warn").otherwise("allow")


def neutral(c: str | Column) -> Column:
    """Fence tokens rewritten, structural tags escaped, invisible characters gone, control characters as spaces."""
    from ..functions.text import CONTROL, INVISIBLE

    t = F.regexp_replace(text_of(c), r"<<<[^<>\n]{0,120}>>>", "<<<neutralised-delimiter>>>")
    t = F.regexp_replace(t, r"(?i)<(/?\s*(?:sources|user_memory|pipeline_notes)\b[^<>\n]{0,120})>", "&lt;$1&gt;")
    return F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), CONTROL, " ")


def resolve(a: str = "a", b: str = "b", superseded_days: int = 180) -> dict[str, Column]:
    """Which of two conflicting rows wins and by what: effective date, modification, authority, recency; else nothing."""
    col = lambda side, x: F.col(f"{side}_{x}")
    rules = [(x, F.col(f"{a}_{x}").isNotNull() & F.col(f"{b}_{x}").isNotNull() & (col(a, x) != col(b, x))) for x in ("effective", "modified", "authority", "seen")]
    by, winner = F.when(rules[0][1], rules[0][0]), F.when(rules[0][1], F.when(col(a, rules[0][0]) > col(b, rules[0][0]), "a").otherwise("b"))
    for x, decided in rules[1:]:
        by, winner = by.when(decided, x), winner.when(decided, F.when(col(a, x) > col(b, x), "a").otherwise("b"))
    gap = F.abs(F.coalesce(col(a, "effective"), col(a, "modified")) - F.coalesce(col(b, "effective"), col(b, "modified"))) / 86400
    return {"by": by.otherwise("indeterminate"), "winner": winner, "gap_days": gap, "superseded": winner.isNotNull() & (gap >= superseded_days)}


def markers(answer: str | Column) -> Column:
    """Citation numbers of [1], [1, 3] and [1; 3], in order."""
    groups = F.regexp_extract_all(text_of(answer), F.lit(r"\[(\d+(?:\s*[,;]\s*\d+)*)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*[,;]\s*"), lambda x: x.cast("int"))))


def answer_leaks(answer: Column, chunk: Column, span: int = 60, step: int = 30) -> Column:
    """Whether a stretch of a chunk's normal text stands in the answer's."""
    from ..functions.text import let, normal

    starts = lambda c: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - span + 1), F.lit(step))
    return let(normal(answer), lambda a: let(normal(chunk), lambda c: (F.length(c) >= span) & F.exists(starts(c), lambda k: F.contains(a, c.substr(k, F.lit(span))))))


def claim_links(terms: DataFrame, like: float = 0.82) -> DataFrame:
    """(a, b, likeness) of claims (id, term, idf) whose shared weight is at least ``like`` of the smaller one's.

    Of the smaller claim less than 1 - ``like`` of the weight is not shared, so one of
    its rarest terms that together outweigh that is: only these look for other claims.
    """
    w = Window.partitionBy("id")
    first = w.orderBy(F.desc("idf"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = terms.groupBy("id").agg(F.sum("idf").alias("mass"))
    lead = terms.withColumn("before", F.sum("idf").over(first) - F.col("idf")).withColumn("mass", F.sum("idf").over(w)).where(F.col("before") <= (1 - like) * F.col("mass") + 1e-9)
    others = terms.join(mass, "id").select(F.col("id").alias("b"), "term", F.col("mass").alias("mb"))
    found = lead.select(F.col("id").alias("a"), "term", F.col("mass").alias("ma")).join(others, "term").where("a <> b and ma <= mb").select("a", "b", "ma").distinct()
    mine, yours = terms.toDF("a", "term", "idf"), terms.select(F.col("id").alias("b"), "term")
    both = found.join(mine, "a").join(yours, ["b", "term"]).groupBy("a", "b", "ma").agg(F.sum("idf").alias("both"))
    return both.select("a", "b", (F.col("both") / F.col("ma")).alias("likeness")).where(F.col("likeness") >= like)


def claim_classes(terms: DataFrame, like: float = 0.82) -> DataFrame:
    """(id, cluster) of all claims (id, term, idf): the least claim that links lead to."""
    return classes(terms.select("id").distinct(), claim_links(terms, like))


#: Characters of passages that are sent to the workers at once.
SPAN_CHARS = 16_000_000


def _run_hashes(text: str, chars: int) -> np.ndarray:
    """Hashes of all stretches of ``chars`` code points, from prefix sums of a polynomial modulo 2**64."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(code) < chars:
        return np.zeros(0, dtype=np.uint64)
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    with np.errstate(over="ignore"):
        mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code) - 1, base, dtype=np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * up, dtype=np.uint64)])
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code) - chars, inverse, dtype=np.uint64)]))
        return (sums[chars:] - sums[:-chars]) * down


def leaked(docs: DataFrame, passages: DataFrame, chars: int = 60) -> DataFrame:
    """(doc_id, item_id) of documents that hold a stretch of a passage: of ``chars`` characters at half steps, or all of a shorter one.

    Stretches are looked up by hash and then compared, so a document is read once
    whatever their number; passages go to the workers in blocks of ``SPAN_CHARS``.
    """
    c = passages.select("item_id", normal("text").alias("c")).where("c <> ''")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("c") - chars + 1), F.lit(chars // 2))
    spans = c.select("item_id", "c", F.explode(at).alias("k")).select("item_id", F.col("c").substr(F.col("k"), F.lit(chars)).alias("span")).distinct()
    total = spans.agg(F.sum(F.length("span"))).first()[0] or 0
    blocks = max(1, -(-total // SPAN_CHARS))
    texts, found = docs.select("doc_id", normal("text").alias("a")), None
    for k in range(blocks):
        own = spans.where(F.pmod(F.xxhash64("item_id", "span"), F.lit(blocks)) == k).collect()
        part = texts.mapInArrow(_held(docs.sparkSession.sparkContext.broadcast(own)), StructType([texts.schema["doc_id"], spans.schema["item_id"]]))
        found = part if found is None else found.union(part)
    return found.distinct() if blocks > 1 else found


def _held(shared):
    def run(batches):
        by_length: dict[int, dict[int, list]] = {}
        for r in shared.value:
            by_length.setdefault(len(r.span), {}).setdefault(int(_run_hashes(r.span, len(r.span))[0]), []).append((r.item_id, r.span))
        known = {n: np.sort(np.fromiter(own, dtype=np.uint64, count=len(own))) for n, own in by_length.items()}
        for b in batches:
            docs, items = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("a").to_pylist(), strict=True):
                hit = set()
                for n, own in by_length.items():
                    h = _run_hashes(text, n)
                    place = np.minimum(np.searchsorted(known[n], h), len(own) - 1)
                    for x in np.unique(h[known[n][place] == h]).tolist():
                        hit |= {item for item, span in own[x] if item not in hit and span in text}
                docs += [doc] * len(hit)
                items += hit
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc_id").type), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def combined(findings: DataFrame, by: str, score: str = "score", digits: int = 3) -> DataFrame:
    """(by, score): the chance that one of several findings is right, each by itself."""
    return findings.groupBy(by).agg(F.round(1 - F.product(1 - F.col(score)), digits).alias("score"))


#: Fixed: what the results of a question it can answer have at least: how many, the best score, the mean, and a spread unless the best is high.
FEW, LOW_TOP, LOW_MEAN, COLLAPSED, SURE = 3, 0.3, 0.25, 0.02, 0.5


def result_signals(hits: DataFrame, query: str = "query", score: str = "score", tie: str = "id", k: int = 5) -> DataFrame:
    """(query, n, top, mean, spread) of the ``k`` best results of each question."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    best = hits.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    s = F.col(score)
    return best.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.max(s).alias("top"), F.avg(s).alias("mean"), (F.max(s) - F.min(s)).alias("spread"))


def out_of_domain(n: str = "n", top: str = "top", mean: str = "mean", spread: str = "spread") -> Column:
    """Why the corpus has no answer, by the first sign; null if it may have one."""
    n, top, mean, spread = map(F.col, (n, top, mean, spread))
    return F.when(n < FEW, "few").when(top < LOW_TOP, "low_top").when(mean < LOW_MEAN, "low_mean").when((spread < COLLAPSED) & (top < SURE), "collapsed")


def domain_verdict(tools: Column, n: str = "n", top: str = "top") -> Column:
    """What becomes of a question: answered, given to a tool where one can take it, or refused."""
    weak = (F.col(n) < FEW) | (F.col(top) < LOW_TOP)
    return F.when(~weak, "answer").when(tools, "tool").otherwise("refuse")
