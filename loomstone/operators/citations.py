"""Citations of answers: every marker is checked against the source that it names, and kept or dropped with a reason.

An answer is cut into sentences; each marker stands for the words of its sentence (or
for the quotation in it).  All words that cite one source meet its text once.  Text is
compared in a normal form whose every character knows the place that it came from, so
what is found is told in the source's own offsets.

What is not there word for word is looked for in every window of the claim's width
that starts at a word and has one of the claim's content words: a window's score is
the better of character likeness and of the share of content words in it.  Shares of
all windows come from sorted positions; likeness is computed best bound first (letters
in common, then longest common subsequence by bit vectors) until no bound can beat the
best so far, so the best of all windows is found without comparing all.

Defined results: a null answer has no markers and no claims; a source of null text
supports nothing; a number without a source is ``unknown_marker``.
"""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers, quotations, ends of sentences and paragraphs, words that support nothing, and thresholds.
MARKER = re.compile(r"\[\s*(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\s*\]")
QUOTED = re.compile(r"\"([^\"]{2,})\"|“([^”]{2,})”|'([^']{4,})'|‘([^’]{4,})’")
SENTENCE_END = re.compile(r"(?<=[.!?:;])\s+|\n+")
PARAGRAPH = re.compile(r"\n\s*\n")
STOP_WORDS = frozenset("and are but can for from has have into its may must not per shall should than that the their them then there these they this those was were when which will with you your".split())
LIKE, QUOTE_LIKE, SHARE = 0.55, 0.9, 0.6
SHORT_SPAN, LONG_SPAN, CLAIM_WORDS, STEM = 12, 600, 5, 4
GROUNDED, COVERED = 0.6, 0.5

REF = "struct<k:int,sentence:int,number:int,probe:string,verbatim:boolean,alone:boolean>"
FOUND = "struct<k:int,sentence:int,reason:string,start:int,end:int,ratio:double>"


class _Folds(dict):
    """A character's letters and digits in normal form, by its code; all else is a space."""

    def __missing__(self, code: int) -> str:
        folded = unicodedata.normalize("NFKC", chr(code)).casefold()
        self[code] = "".join(x if x.isalnum() else " " for x in folded)
        return self[code]


_FOLDS = _Folds()


def normal_form(text: str) -> tuple[str, np.ndarray]:
    """Words in normal form with one space between them, and for each character the place in ``text`` that it came from."""
    flat = text.translate(_FOLDS)
    normal = " ".join(flat.split())
    if not normal:
        return "", np.zeros(0, np.int64)
    place = np.arange(len(text))
    if len(flat) > len(text):  # no character becomes nothing, some become several
        code, width = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.ones(len(text), np.int64)
        for c in map(ord, set(text)):
            if len(_FOLDS[c]) > 1:
                width[code == c] = len(_FOLDS[c])
        place = np.repeat(place, width)
    space = np.frombuffer(flat.encode("utf-32-le"), np.uint32) == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    solid = np.flatnonzero(~space)
    keep[: solid[0]] = False
    keep[solid[-1] + 1 :] = False
    return normal, place[keep]


def content_words(normal: str) -> list[str]:
    """The words that a claim is about: those with a digit, and longer ones that are no stop words."""
    return [w for w in normal.split() if any(map(str.isdigit, w)) or (len(w) >= 3 and w not in STOP_WORDS)]


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Bits of a word of ``common_with``, so that a carry has room in it, and cells (words by characters by windows) that it has at once.
WORD, CELLS = 62, 1 << 19
#: Windows of best bounds that are compared before the others.
FIRST = 128


def common_with(a: str, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``common`` of ``a`` with each window of a text (codes of its characters): all windows go on by one character at a time."""
    letters, words = sorted(set(map(ord, a))), -(-len(a) // WORD)
    where = np.zeros((words, len(letters) + 1), np.int64)  # the last column is of letters that ``a`` has not
    for k, c in enumerate(a):
        where[k // WORD, letters.index(ord(c))] |= 1 << k % WORD
    at = np.minimum(np.searchsorted(letters, code), len(letters) - 1)
    letter = np.append(np.where(np.array(letters)[at] == code, at, len(letters)), len(letters))
    full = np.full((words, 1), (1 << WORD) - 1)
    full[-1] = (1 << len(a) - WORD * (words - 1)) - 1
    out, length = np.zeros(len(start), np.int64), int((end - start).max(initial=1))
    step = max(FIRST, CELLS // (words * length))
    for first in range(0, len(start), step):
        s, e = start[first : first + step], end[first : first + step]
        at = s + np.arange(length)[:, None]
        now = where[:, letter[np.where(at < e, at, len(code))]]
        row = np.repeat(full, len(s), axis=1)
        hit, total = np.empty_like(row), np.empty_like(row)
        for j in range(length):
            np.bitwise_and(row, now[:, j], out=hit)
            np.add(row, hit, out=total)
            for k in range(1, words):
                total[k] += total[k - 1] >> WORD
            np.bitwise_xor(row, hit, out=row)
            np.bitwise_and(total, full, out=total)
            np.bitwise_or(row, total, out=row)
        out[first : first + step] = len(a) - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
    return out


def blocks(a: str, b: str) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


class Source:
    """A text in normal form with the places of its words."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.normal, self.place = normal_form(self.text)
        self.code = np.frombuffer(self.normal.encode("utf-32-le"), np.uint32)
        space = np.flatnonzero(self.code == 32)
        self.start = np.concatenate([[0], space + 1]) if self.normal else np.zeros(0, np.int64)
        self.end = np.append(space, len(self.normal)) if self.normal else np.zeros(0, np.int64)
        self.padded = f" {self.normal} "

    @functools.cached_property
    def numbers(self) -> set[str]:
        return set(re.findall(r"\d{2,}", self.normal))

    def with_stem(self, stem: str) -> np.ndarray:
        """The words that begin with a stem; a shorter one is a whole word."""
        look, found, at = f" {stem}" if len(stem) == STEM else f" {stem} ", [], -1
        while (at := self.padded.find(look, at + 1)) >= 0:
            found.append(at)
        return np.searchsorted(self.start, found)

    def original(self, start: int, end: int) -> tuple[int, int]:
        return int(self.place[start]), int(self.place[end - 1]) + 1

    def windows(self, claim: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, share) of the windows in normal form that have a content word of a claim, and the share of its content words that they have."""
        need = content_words(claim)
        width = len(claim) + 2 * max(8, len(claim) // 4)
        # A window has whole words; a word longer than it comes alone.
        stop = np.maximum(np.searchsorted(self.end, self.start + width, side="right"), np.arange(len(self.start)) + 1)
        n = np.arange(len(self.start))
        hits = np.zeros(len(n), np.int64)
        for stem, times in Counter(w[:STEM] for w in need).items():
            at = self.with_stem(stem)
            hits += times * (np.searchsorted(at, n) < np.searchsorted(at, stop))
        use = np.flatnonzero(hits)
        return self.start[use], self.end[stop[use] - 1], hits[use] / max(1, len(need))

    def _letters_in_common(self, claim: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each window how many letters it has in common with a claim, in any order."""
        out = np.zeros(len(start), np.int64)
        for c in set(claim):
            sums = np.concatenate([[0], np.cumsum(self.code == ord(c))])
            out += np.minimum(sums[end] - sums[start], claim.count(c))
        return out

    def best(self, claim: str, floor: float, shares: bool) -> tuple[int, int, float] | None:
        """(start, end, score) of the best window in normal form, the first of equal ones; None if all are below ``floor``."""
        start, end, share = self.windows(claim)
        if not len(start):
            return None
        score = np.where(share >= SHARE, share, 0.0) if shares else np.zeros(len(start))
        size = len(claim) + end - start
        bound = np.maximum(2 * self._letters_in_common(claim, start, end) / size, score)
        top = max(floor, float(score.max()))
        open_ = np.flatnonzero((bound >= top) & (score < 1))
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        # A few of best bounds first, for what they reach leaves few of the others open.
        top = self._likeness(claim, open_[:FIRST], start, end, size, score, top)
        left = open_[FIRST:]
        self._likeness(claim, left[bound[left] >= top], start, end, size, score, top)
        k = int(score.argmax())
        return (int(start[k]), int(end[k]), float(score[k])) if score[k] >= floor else None

    def _likeness(self, claim: str, now: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, score: np.ndarray, top: float) -> float:
        """Raises the scores of windows to their likeness where that can reach ``top``; the best score so far."""
        if not len(now):
            return top
        bound = 2 * common_with(claim, self.code, start[now], end[now]) / size[now]
        known: dict[str, float] = {}  # a text that repeats itself has many equal windows
        for n in np.argsort(-bound, kind="stable").tolist():
            if bound[n] < top:
                break
            k = now[n]
            window = self.normal[start[k] : end[k]]
            if window not in known:
                known[window] = blocks(claim, window).ratio()
            score[k] = max(score[k], known[window])
            top = max(top, float(score[k]))
        return top

    def find(self, probe: str, verbatim: bool, numbers: bool) -> tuple[int, int, float] | None:
        """Where a span of an answer is in the text, and how alike: exactly, or as its best window."""
        claim, _ = normal_form(probe[:LONG_SPAN])
        if not claim or not self.normal:
            return None
        if numbers and not set(re.findall(r"\d{2,}", claim)) <= self.numbers:
            return None
        if (at := self.normal.find(claim)) >= 0:
            return *self.original(at, at + len(claim)), 1.0
        if not (found := self.best(claim, QUOTE_LIKE if verbatim else LIKE, not verbatim)):
            return None
        low, high, score = found
        same = [m for m in blocks(claim, self.normal[low:high]).get_matching_blocks() if m.size]
        if same:
            first, last = low + same[0].b, low + same[-1].b + same[-1].size
            if 4 * sum(m.size for m in same) >= last - first:  # else the whole window: what matches is scattered
                inner = self.normal[first:last]
                low, high = first + len(inner) - len(inner.lstrip()), last - len(inner) + len(inner.rstrip())
        return *self.original(low, high), score


def plain(text: str) -> str:
    """A text without its markers."""
    return " ".join(MARKER.sub(" ", text).split())


def sentences(answer: str) -> list[tuple[int, int]]:
    """Starts and ends of the sentences that are not blank."""
    edges = [0, *(x for m in SENTENCE_END.finditer(answer) for x in m.span()), len(answer)]
    found = []
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        inner = answer[i:j]
        if inner.strip():
            found.append((i + len(inner) - len(inner.lstrip()), j - len(inner) + len(inner.rstrip())))
    return found


def quotation(text: str) -> str | None:
    """The longest quotation of a sentence."""
    found = [g for m in QUOTED.finditer(text) for g in m.groups() if g]
    return max(found, key=len).strip() or None if found else None


def read_answer(answer: str | None) -> tuple[list[int], list[dict]]:
    """The sentences that claim something, and every marker with what it has to support."""
    answer = answer or ""
    cut = sentences(answer)
    own = [plain(answer[i:j]) for i, j in cut]
    claims = [k for k, s in enumerate(own) if s and not s.endswith("?") and len(s.split()) >= CLAIM_WORDS]
    refs: list[dict] = []
    for k, (i, j) in enumerate(cut):
        numbers = [int(x) for m in MARKER.finditer(answer, i, j) for x in re.findall(r"\d+", m[1])]
        span = own[k]
        if len(span) < SHORT_SPAN and k and not PARAGRAPH.search(answer, cut[k - 1][1], i):
            span = f"{own[k - 1]} {span}".strip()  # too short to say anything alone
        quote = quotation(own[k])
        verbatim = bool(quote) and len(quote) >= SHORT_SPAN and bool(span)
        refs += [{"k": len(refs) + n, "sentence": k, "number": x, "probe": quote if verbatim else span, "verbatim": verbatim, "alone": len(numbers) == 1} for n, x in enumerate(numbers)]
    return claims, refs


def read_answers(answers: DataFrame) -> DataFrame:
    """answer_id, answer, claims (sentences that state something) and refs (the markers) of answers (answer_id, answer)."""

    def run(batches):
        for pdf in batches:
            got = [read_answer(x) for x in pdf["answer"]]
            yield pd.DataFrame({"answer_id": pdf["answer_id"], "answer": pdf["answer"], "claims": [c for c, _ in got], "refs": [r for _, r in got]})

    kind = dict(answers.dtypes)["answer_id"]
    return answers.select("answer_id", "answer").mapInPandas(run, f"answer_id {kind}, answer string, claims array<int>, refs array<{REF}>")


def _judge(refs, source: Source | None) -> list[dict]:
    out = []
    for r in refs:
        found = {"k": r["k"], "sentence": r["sentence"], "reason": None, "start": None, "end": None, "ratio": 0.0}
        if source is None:
            found["reason"] = "unknown_marker"
        elif not r["probe"]:
            found["reason"] = "empty_span"
        elif at := source.find(r["probe"], r["verbatim"], r["alone"]):
            found |= {"start": at[0], "end": at[1], "ratio": round(at[2], 4)}
        else:
            found["reason"] = "quote_not_found" if r["verbatim"] else "span_not_found"
        out.append(found)
    return out


def checked(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, number, source_id, k, sentence, reason (null where the source supports the words), start, end, ratio and quoted: a row for each marker.

    ``parsed`` is from ``read_answers``; ``sources`` has (answer_id, number, source_id, text).
    All markers of one source travel together, so its text is read once.
    """
    by_source = parsed.select("answer_id", F.explode("refs").alias("r")).groupBy("answer_id", F.col("r.number").alias("number")).agg(F.array_sort(F.collect_list("r")).alias("refs"))
    met = by_source.join(sources.select("answer_id", "number", "source_id", "text", F.lit(True).alias("printed")), ["answer_id", "number"], "left")

    def run(batches):
        for pdf in batches:
            found = [_judge(refs, Source(text) if printed is True else None) for refs, text, printed in zip(pdf["refs"], pdf["text"], pdf["printed"], strict=True)]
            yield pdf[["answer_id", "number", "source_id", "text"]].assign(found=found)

    kinds = dict(met.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("answer_id", "number", "source_id", "text")) + f", found array<{FOUND}>"
    each = met.mapInPandas(run, schema).select("answer_id", "number", "source_id", "text", F.inline("found"))
    quoted = F.when(F.col("reason").isNull(), F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")))
    return each.select("answer_id", "number", "source_id", "k", "sentence", "reason", "start", "end", "ratio", quoted.alias("quoted"))


def citations(marks: DataFrame) -> DataFrame:
    """The best supported marker of each source of an answer, the first of equal ones."""
    best = F.max_by(F.struct("source_id", "k", "start", "end", "ratio", "quoted"), F.struct("ratio", -F.col("k")))
    return marks.where("reason IS NULL").groupBy("answer_id", "number").agg(best.alias("b")).select("answer_id", "number", "b.*")


def cleaned(answer: str | None, kept) -> str:
    """An answer without the markers that support nothing."""
    keep = {int(x) for x in kept if x is not None}
    out = MARKER.sub(lambda m: "".join(f"[{int(x)}]" for x in re.findall(r"\d+", m[1]) if int(x) in keep), answer or "")
    return re.sub(r"[ \t]+([.,;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", out))


def report(parsed: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per answer: attempted, verified, unknown numbers, claims, cited claims, validity, coverage, groundedness (the lesser), verdict, cleaned answer."""
    ok = F.col("reason").isNull()
    by_answer = marks.groupBy("answer_id").agg(
        F.count_if(ok).alias("verified"),
        F.array_sort(F.collect_set(F.when(F.col("reason") == "unknown_marker", F.col("number")))).alias("unknown"),
        F.collect_set(F.when(ok, F.col("sentence"))).alias("cited"),
        F.collect_set(F.when(ok, F.col("number"))).alias("kept"),
    )
    j = parsed.join(by_answer, "answer_id", "left")
    none = F.array().cast("array<int>")
    j = j.select(
        "answer_id", "answer", F.size("refs").alias("attempted"), F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce("unknown", none).alias("unknown"),
        F.size("claims").alias("claims"), F.size(F.array_intersect("claims", F.coalesce("cited", none))).alias("cited"), F.coalesce("kept", none).alias("kept"),
    )
    # Without markers an answer that claims something has no support, and one that claims nothing needs none.
    validity = F.when(F.col("attempted") > 0, F.col("verified") / F.col("attempted")).when(F.col("claims") > 0, 0.0).otherwise(1.0)
    coverage = F.when(F.col("claims") > 0, F.col("cited") / F.col("claims")).otherwise(1.0)
    j = j.withColumn("validity", validity).withColumn("coverage", coverage)
    verdict = F.when((F.col("claims") == 0) & (F.col("attempted") == 0), "not_applicable").when(F.col("validity") < GROUNDED, "ungrounded").when(F.col("coverage") < COVERED, "partial").otherwise("grounded")
    j = j.withColumn("verdict", verdict).withColumn("uncertain", F.col("validity") < GROUNDED)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(cleaned=[cleaned(a, k) for a, k in zip(pdf["answer"], pdf["kept"], strict=True)]).drop(columns=["answer", "kept"])

    kind = dict(j.dtypes)["answer_id"]
    out = j.select("answer_id", "answer", "kept", "attempted", F.col("verified").cast("int").alias("verified"), "unknown", "claims", "cited", F.round("validity", 4).alias("validity"), F.round("coverage", 4).alias("coverage"), F.round(F.least("validity", "coverage"), 4).alias("groundedness"), "verdict", "uncertain")
    return out.mapInPandas(run, f"answer_id {kind}, attempted int, verified int, unknown array<int>, claims int, cited int, validity double, coverage double, groundedness double, verdict string, uncertain boolean, cleaned string")


def best_windows(pairs: DataFrame) -> DataFrame:
    """id, n (windows that have a content word of the claim), share (the best) and start, end, ratio of what was found, in the source's offsets; of (id, claim, source)."""

    def run(batches):
        for pdf in batches:
            out = []
            for claim, text in zip(pdf["claim"], pdf["source"], strict=True):
                source = Source(text)
                *_, share = source.windows(normal_form((claim or "")[:LONG_SPAN])[0])
                at = source.find(claim or "", False, False) or (None, None, 0.0)
                out.append((len(share), float(share.max()) if len(share) else 0.0, *at))
            frame = pd.DataFrame(out, columns=["n", "share", "start", "end", "ratio"])
            yield frame.astype({"start": "Int64", "end": "Int64"}).assign(id=pdf["id"].to_numpy())[["id", "n", "share", "start", "end", "ratio"]]

    return pairs.select("id", "claim", "source").mapInPandas(run, "id long, n long, share double, start long, end long, ratio double")


# --- columns --------------------------------------------------------------------------


def snippet(text: str, chars: int = 120, more: str = "…") -> Column:
    """A text of at most ``chars`` characters, cut at the last space before them, with a sign that there is more."""
    head = F.substring(text, 1, chars)
    back = F.instr(F.reverse(head), " ")
    cut_at = F.when(back > 0, head.substr(F.lit(1), F.lit(chars) - back)).otherwise(head)
    return F.when(F.length(text) <= chars, F.col(text)).otherwise(F.concat(cut_at, F.lit(more)))


def claims(text: str, least: int = CLAIM_WORDS) -> Column:
    """Whether a sentence states something: words enough, and no question."""
    x = F.trim(text)
    return (x != "") & ~x.endswith("?") & (F.size(F.split(x, r"\s+")) >= least)


def with_notice(answer: str, notice: str, sign: str) -> Column:
    """An answer with a notice below, unless it has one by its sign."""
    return F.when(F.contains(answer, F.lit(sign)), F.col(answer)).otherwise(F.concat(answer, F.lit(f"\n\n{notice}")))


def longest_quotation(text: Column) -> Column:
    """The longest text between double quotes; null if there is none."""
    quotes = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.struct(F.length(x).alias("n"), x.alias("q")))
    return F.array_max(quotes)["q"]
