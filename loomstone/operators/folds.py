"""Decisions that depend on those before them, for one bounded group at a time: packing, merging, verifying, comparing."""

from __future__ import annotations

import difflib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

STEM, QUOTE, CLOSE = 4, 0.9, 0.6
_TOKEN = re.compile(r"\w+")
_NEGATION = re.compile(r"\b(?:not|no|never|cannot|nicht|kein|ne|pas|sin)\b", re.I)
_DUTY = re.compile(r"\b(?:must|shall|required|may|allowed|permitted|prohibited)\b", re.I)
_QUANTITY = re.compile(r"(\d+(?:[.,]\d+)?)\s*(%|[^\W\d_]+)")


def in_order(rows: DataFrame, by: str, order: list, step, schema: str) -> DataFrame:
    """What ``step(state, row)`` makes of the rows of each group in order: (state, values or None); a group's first state is None.

    Groups come one after the other and a row at a time, so many small ones cost no
    more than their rows and a large one needs no room; rows are tuples of ``rows``.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key:
                    key, state = row[0], None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], names=names)

    kinds = list(to_arrow_schema(StructType.fromDDL(schema)))
    columns = [by, *(c for c in rows.columns if c != by)]
    return rows.select(columns).repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def pack_context(sources: DataFrame, budget: int) -> DataFrame:
    """(grp, id, dropped_reason): sources by falling density, each taken if it still fits; one that does not is passed over."""

    def step(left, row):
        grp, i, n, _ = row
        left = budget if left is None else left
        return (left - n, (grp, i, None)) if n <= left else (left, (grp, i, "budget"))

    return in_order(sources.select("grp", "id", "tokens", "density"), "grp", [F.desc("density"), "id"], step, "grp long, id long, dropped_reason string")


def select_history(turns: DataFrame, budget: int, always: int = 4) -> DataFrame:
    """(conv_id, turn): pinned turns and the last few always, then newest first what still fits."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", ascending=False).reset_index(drop=True)
        must = pdf["pinned"] | (pdf.index < always)
        left, take = budget - int(pdf.loc[must, "tokens"].sum()), list(must)
        for k in pdf.index[~must]:
            if pdf["tokens"][k] <= left:
                take[k] = True
                left -= pdf["tokens"][k]
        return pdf.loc[take, ["conv_id", "turn"]].sort_values("turn")

    return turns.groupBy("conv_id").applyInPandas(fold, "conv_id long, turn long")


def merge_memories(memories: DataFrame, like: float = 0.9) -> DataFrame:
    """(user, id, into, hits): strongest first, a memory of one kind close to a kept one is merged into it; hits add up."""
    import numpy as np

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["salience", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf["vector"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        kept, into = [], []
        for k in range(len(pdf)):
            j = next((j for j in kept if pdf["kind"][j] == pdf["kind"][k] and v[j] @ v[k] >= like), k)
            if j == k:
                kept.append(k)
            into.append(int(pdf["id"][j]))
        total = pdf["hits"].groupby(pd.Series(into)).sum()
        return pd.DataFrame({"user": pdf["user"], "id": pdf["id"], "into": into, "hits": [int(total[x]) for x in into]})

    return memories.groupBy("user").applyInPandas(fold, "user long, id long, into long, hits long")


def content(text: str) -> list[str]:
    return [w for w in _TOKEN.findall(text.lower()) if len(w) > 2]


def stem_recall(need: str, window: str) -> float:
    words, low = content(need), window.lower()
    return sum(w[:STEM] in low for w in words) / len(words) if words else 0.0


def verify(claim: str, source: str) -> tuple[str, float]:
    """``number`` if a number is missing, ``exact``, ``close`` (with its score) or ``none``, by the best window of the source."""
    if not set(re.findall(r"\d+(?:[.,]\d+)?", claim)) <= set(re.findall(r"\d+(?:[.,]\d+)?", source)):
        return "number", 0.0
    a, b = " ".join(_TOKEN.findall(claim.lower())), " ".join(_TOKEN.findall(source.lower()))
    if not a:
        return "none", 0.0
    if a in b:
        return "exact", 1.0
    best = 0.0
    for anchor in sorted(set(content(a)), key=lambda w: (-len(w), w))[:3]:
        for m in list(re.finditer(re.escape(anchor), b))[:8]:
            start = max(0, m.start() - a.find(anchor))
            window = b[start : start + len(a) + 16]
            best = max(best, difflib.SequenceMatcher(None, a, window, autojunk=False).ratio(), stem_recall(a, window))
    return ("close", round(best, 4)) if best >= CLOSE else ("none", round(best, 4))


def verify_claims(pairs: DataFrame) -> DataFrame:
    """id, verdict and score of (id, claim, source)."""

    def run(batches):
        for pdf in batches:
            got = [verify(c or "", s or "") for c, s in zip(pdf["claim"], pdf["source"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "verdict": [x for x, _ in got], "score": [y for _, y in got]})

    return pairs.select("id", "claim", "source").mapInPandas(run, "id long, verdict string, score double")


def quantities(text: str) -> dict[str, set[str]]:
    """Numbers with units by the three content words before them."""
    out: dict[str, set[str]] = {}
    for m in _QUANTITY.finditer(text):
        before = content(text[max(0, m.start() - 160) : m.start()])[-3:]
        if before:
            out.setdefault(" ".join(before) + " " + m[2].lower(), set()).add(m[1].replace(",", "."))
    return out


def numeric(a: str, b: str) -> str | None:
    """The first quantity of one key on which two texts share no value."""
    qa, qb = quantities(a), quantities(b)
    return next((k for k in qa if k in qb and not qa[k] & qb[k]), None)


def polarity(a: str, b: str) -> bool:
    """Whether both texts state a duty and one of them negates it."""
    return bool(_DUTY.search(a) and _DUTY.search(b)) and bool(_NEGATION.search(a)) != bool(_NEGATION.search(b))


def conflict(a: str, b: str) -> tuple[str, float]:
    """How two texts disagree: on a quantity of one key, else on a duty that one of them negates."""
    if numeric(a, b) is not None:
        return "numeric", 0.75
    if polarity(a, b):
        return "polarity", 0.55
    return "none", 0.0


def conflicts(pairs: DataFrame) -> DataFrame:
    """id, kind and confidence of (id, a, b)."""

    def run(batches):
        for pdf in batches:
            got = [conflict(a or "", b or "") for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "kind": [x for x, _ in got], "confidence": [y for _, y in got]})

    return pairs.select("id", F.col("a"), F.col("b")).mapInPandas(run, "id long, kind string, confidence double")
