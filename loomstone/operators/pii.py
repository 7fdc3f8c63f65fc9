"""Personal data and secrets in text: recognisers as data, checks, overlap, redaction."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import spread

#: Characters on both sides of a match that are searched for its context words, and what a find adds.
REACH, BOOST, LEAST = 64, 0.15, 0.5


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    doubled = (d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def iban(value: str) -> bool:
    v = re.sub(r"\s", "", value).upper()
    return 15 <= len(v) <= 34 and v.isalnum() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def verhoeff(value: str) -> bool:
    """Dihedral checksum: digits are elements of D5, place k applies the k-th power of a permutation."""
    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    total = 0
    for k, c in enumerate(reversed([c for c in value if c.isdigit()])):
        d = int(c)
        for _ in range(k % 8):
            d = turn[d]
        a, b = total, d
        total = (a + b) % 5 if a < 5 and b < 5 else (a + b - 5) % 5 + 5 if a < 5 else (a - 5 - b) % 5 + 5 if b < 5 else (a - b) % 5
    return total == 0


def national_id(value: str) -> bool:
    return sum(c.isdigit() for c in value) == 12 and verhoeff(value)


def web_token(value: str) -> bool:
    head = value.split(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return value.count(".") == 2 and isinstance(found, dict) and "alg" in found


@dataclass(frozen=True)
class Recogniser:
    name: str
    kind: str
    pattern: str
    score: float
    check: str = ""
    context: tuple[str, ...] = ()
    needs_context: bool = False
    trims: bool = False
    group: int = 0


CHECKS = {"luhn": luhn, "iban": iban, "national_id": national_id, "web_token": web_token}
_PHONE = ("phone", "mobile", "tel", "call", "contact", "fax")
#: Patterns, scores and context words of each kind of data.
RECOGNISERS = (
    Recogniser("national_id", "AADHAAR", r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", 0.75, "national_id", ("aadhaar", "aadhar", "uidai", "uid")),
    Recogniser("tax_id", "PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.7, context=("pan", "permanent account", "income tax", "itr")),
    Recogniser("swift", "SWIFT_CODE", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.55, context=("swift", "bic", "bank", "iban", "wire", "beneficiary"), needs_context=True),
    Recogniser("jwt", "JWT", r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*", 0.9, "web_token"),
    Recogniser("key_sk", "API_KEY", r"\bsk-(?:ant-)?[A-Za-z0-9_-]{16,}\b", 0.9),
    Recogniser("key_aws", "API_KEY", r"\bAKIA[0-9A-Z]{16}\b", 0.9),
    Recogniser("key_github", "API_KEY", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", 0.9),
    Recogniser("key_slack", "API_KEY", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", 0.9),
    Recogniser("key_google", "API_KEY", r"\bAIza[0-9A-Za-z_-]{35}\b", 0.9),
    Recogniser("key_assigned", "API_KEY", r"(?i)(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*[\"']?([A-Za-z0-9_\-.]{16,})", 0.6, group=1),
    Recogniser("email", "EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.9),
    Recogniser("card", "CREDIT_CARD", r"\b\d(?:[ -]?\d){12,18}\b", 0.8, "luhn", ("card", "credit", "debit", "visa", "mastercard", "amex", "cvv"), trims=True),
    Recogniser("iban", "IBAN_CODE", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Za-z0-9]{4})+(?:[ ]?[A-Za-z0-9]{1,3})?\b", 0.8, "iban", ("iban", "account", "bank", "payment", "transfer"), trims=True),
    Recogniser("ssn", "US_SSN", r"\b(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.7, context=("ssn", "social security", "taxpayer")),
    Recogniser("phone_international", "PHONE_NUMBER", r"\+\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ .-]?){1,4}\d{2,4}\b", 0.6, context=_PHONE),
    Recogniser("phone_national", "PHONE_NUMBER", r"\b\d{3}[.-]\d{3}[.-]\d{4}\b", 0.55, context=_PHONE),
    Recogniser("ipv4", "IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", 0.6),
)
_COMPILED = [(r, re.compile(r.pattern)) for r in RECOGNISERS]


def find(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every match that passes its check, with what its context adds."""
    for r, pattern in _COMPILED:
        for m in pattern.finditer(text):
            start, end = m.span(r.group)
            if r.check:
                ok = CHECKS[r.check]
                while not ok(text[start:end]):
                    # A match may have run on into what follows: give up its last group.
                    cut = max(text.rfind(" ", start, end), text.rfind("-", start, end)) if r.trims else -1
                    if cut <= start:
                        break
                    end = cut
                else:
                    ok = None
                if ok:
                    continue
            around = text[max(0, start - REACH) : end + REACH].lower()
            near = any(w in around for w in r.context)
            if r.needs_context and not near:
                continue
            yield r.kind, start, end, min(1.0, r.score + BOOST * near)


def analyse(text: str, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """Matches of at least a score, without overlaps: the better score wins, then the longer, then the earlier."""
    kept: list[tuple[str, int, int, float]] = []
    for m in sorted((m for m in find(text) if m[3] >= least), key=lambda m: (-m[3], m[1] - m[2], m[1])):
        if all(m[2] <= k[1] or k[2] <= m[1] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[1])


def pseudonym(value: str, kind: str, key: bytes = b"loomstone") -> str:
    return f"<{kind}:{hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:16]}>"


def redact(text: str, found: list[tuple[str, int, int, float]], mode: str = "mask") -> str:
    for kind, start, end, _ in reversed(found):
        value = text[start:end]
        text = text[:start] + (f"<{kind}>" if mode == "mask" else pseudonym(value, kind) if mode == "hash" else "*" * max(0, len(value) - 4) + value[-4:]) + text[end:]
    return text


def scan(docs: DataFrame, id_col: str, text_col: str, mode: str = "mask") -> DataFrame:
    """id, findings (kind, start, end, score), kinds, top score and the redacted text of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                t = t or ""
                found = analyse(t)
                out.append((i, [{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in found], sorted({m[0] for m in found}), max((m[3] for m in found), default=0.0), redact(t, found, mode)))
            yield pd.DataFrame(out, columns=["id", "findings", "kinds", "top", "redacted"])

    schema = "id long, findings array<struct<kind string, start int, end int, score double>>, kinds array<string>, top double, redacted string"
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, schema)


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, start, end, score) of every match that passes its check, overlaps and low scores included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *m) for i, t in zip(pdf["id"], pdf["text"], strict=True) for m in find(t or "")]
            yield pd.DataFrame(out, columns=["id", "kind", "start", "end", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, kind string, start int, end int, score double")


def verified(findings: DataFrame, rejected: DataFrame, floor: float = 0.0) -> DataFrame:
    """Findings (id, kind, start, end, score) without those of at least ``floor`` that a second look (id, kind, start, end) rejected."""
    no = rejected.select("id", "kind", "start", "end").distinct().withColumn("_no", F.lit(True))
    return findings.join(no, ["id", "kind", "start", "end"], "left").where(F.col("_no").isNull() | (F.col("score") < floor)).drop("_no")
