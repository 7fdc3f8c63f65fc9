"""Language identification of words, spans and documents.

Method: the script of a word (by ranges of code points) narrows its candidate
languages to those that use the script; hashed character trigrams score the word
for each candidate; Viterbi over the words of a text, with a penalty for each
switch, labels its spans.  A document gets the language with the most letters.

The model is fitted on about ``PER_LANG`` labelled rows of each language with up
to ``LONGEST`` characters, chosen by a hash of id and text; prediction reads the
text alone.

Defined results: a null text or one without letters is ``und`` with score 0; words
without letters take the label of their neighbours; with no labelled row at all
every document is ``und``; rows with a null id count as not held out; of languages
with equally many letters the first by name wins, and equal texts are labelled alike;
an empty table gives no rows.  Columns are read by the names given, others pass as told.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, kept_schema, let_go, rows, ship, with_kept

PER_LANG = 1000
LONGEST = 20_000
TABLE_BITS = 18
SWITCH = 12.0
#: A language uses a script that has at least this share of its letters.
USES = 0.01
#: Fixed: first code point of each run of scripts, and the script's name.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([x for x, _ in SCRIPTS], dtype=np.uint32)
_NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(x) for _, x in SCRIPTS])


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of ``^word$`` for all words in turn, how many each has, and each word's script; words have letters."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 2) - (size + 2)
    c = code.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
        h = (h * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - TABLE_BITS)
    keep = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    script = _SCRIPT_OF[np.searchsorted(_STARTS, code[start + 1 + size // 2], side="right") - 1]
    return h[keep].astype(np.int64), size, script


class Model:
    """Scores of words by language.  Picklable; its size is 2**TABLE_BITS floats a language."""

    def __init__(self, langs: list[str], texts: list[list[str]]):
        self.langs = langs
        n = max(1, len(langs))
        # 2**TABLE_BITS floats a language, here as in the model.
        counts, scripts = np.zeros((1 << TABLE_BITS, n), dtype=np.float32), np.zeros((len(_NAMES), n))
        for k, own in enumerate(texts):
            for at in range(0, len(own), 200):
                words = [w for t in own[at : at + 200] for x in t.lower().split() if (w := letters_of(x))]
                if words:
                    tri, size, script = _trigrams(words)
                    counts[:, k] += np.bincount(tri, minlength=1 << TABLE_BITS)
                    scripts[:, k] += np.bincount(script, weights=size, minlength=len(_NAMES))
        total = counts.sum(axis=0, dtype=np.float64)
        seen = max(1, int(counts.any(axis=1).sum()))
        counts += 0.5
        self.table = np.log(counts, out=counts)
        self.table -= np.log(total + 0.5 * (seen + 1)).astype(np.float32)
        self.table -= self.table.mean(axis=1, keepdims=True)  # what all languages share does not tell them apart
        self.uses = scripts >= np.maximum(USES * scripts.sum(axis=0), 1)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word with letters; languages that the script rules out are far below."""
        tri, size, script = _trigrams(words)
        out = np.add.reduceat(self.table[tri], np.cumsum(size) - size, axis=0)
        allowed = self.uses[script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, -1e4).astype(np.float32)


class Labeller(dict):
    """Maps a token to the slot of its scores; keeps the tokens seen of late."""

    def __init__(self, model: Model, most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.known, self.weight, self.slots = np.zeros((1 << 12, max(1, len(self.model.langs))), dtype=np.float32), np.zeros(1 << 12, dtype=np.int64), 0

    def __missing__(self, token: str) -> int:
        slot = self[token] = self.slots + len(self.new)
        self.new.append(token)
        return slot

    def _learn(self) -> None:
        words = [letters_of(x) for x in self.new]
        weight = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        scores = np.zeros((len(words), self.known.shape[1]), dtype=np.float32)
        if (at := np.flatnonzero(weight)).size:
            scores[at] = self.model.scores([words[k] for k in at])
        while self.slots + len(words) > len(self.weight):
            self.known, self.weight = np.concatenate([self.known, np.zeros_like(self.known)]), np.concatenate([self.weight, np.zeros_like(self.weight)])
        self.known[self.slots : self.slots + len(words)] = scores
        self.weight[self.slots : self.slots + len(words)] = weight
        self.slots, self.new = self.slots + len(words), []

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the language number of each of its tokens, and the tokens' letters."""
        if self.slots > self.most:
            self._reset()
        tokens = [t.lower().split() for t in texts]
        n = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        slots = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(n.sum()))
        if self.new:
            self._learn()
        labels = viterbi(self.known, slots, n, SWITCH)
        cut = np.cumsum(n)[:-1]
        return np.split(labels, cut), np.split(self.weight[slots], cut)


def viterbi(known: np.ndarray, slots: np.ndarray, n: np.ndarray, switch: float) -> np.ndarray:
    """The best labels of many sequences at once: ``slots`` are the rows of ``known`` of all of them in turn, ``n`` their lengths."""
    out = np.zeros(len(slots), dtype=np.int32)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return out
    length, begin = n[order], (np.cumsum(n) - n)[order]
    steps = int(length[0])
    live = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences that have a word at each step
    best, stay = [], []
    v = known[slots[begin]].copy()
    for t in range(1, steps):
        b = int(live[t])
        u = v[:b]
        top = u.argmax(axis=1)
        floor = u[np.arange(b), top] - switch
        s = u >= floor[:, None]
        best.append(top.astype(np.int32))
        stay.append(s)
        v[:b] = np.maximum(u, floor[:, None]) + known[slots[begin[:b] + t]]
    now = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        b = int(live[t])
        out[begin[:b] + t] = now[:b]
        if t:
            now[:b] = np.where(stay[t - 1][np.arange(b), now[:b]], now[:b], best[t - 1])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, longest: int = LONGEST) -> Model:
    """A model from about ``per_lang`` rows of each language among ``docs``."""
    d = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(2)).alias("h"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    count = {r.lang: r.n for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in count.items():
        limit = min(-(1 << 63) + int(per_lang / n * (1 << 64)), (1 << 63) - 1)
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= F.lit(limit)))
    found: dict[str, list[str]] = {lang: [] for lang in sorted(count)}
    for r in d.where(chosen).orderBy("lang", "h", "text").select("lang", "text").collect() if count else []:
        found[r.lang].append(r.text)
    return Model(list(found), list(found.values()))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (its share of the letters) and, if asked for, spans (lang, first_word, n_words)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang string, first_word int, n_words int>>" * spans
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches):
        let_go()
        m = shared.value
        labeller = Labeller(m)
        for b in chunks(batches):
            langs, scores, parts = [], [], []
            for label, weight in zip(*labeller.label([x or "" for x in b.column("text").to_pylist()]), strict=True):
                share = np.bincount(label, weights=weight, minlength=max(1, len(m.langs)))
                if not m.langs or not share.sum():
                    langs.append("und")
                    scores.append(0.0)
                    parts.append([])
                    continue
                k = int(share.argmax())
                langs.append(m.langs[k])
                scores.append(float(share[k] / share.sum()))
                if spans:
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]]).tolist()
                    parts.append([{"lang": m.langs[label[i]], "first_word": i, "n_words": j - i} for i, j in zip(cut, cut[1:], strict=False)])
            columns = [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + [pa.array(parts, kind)] * spans
            yield with_kept(b, columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    d = rows(docs, id_col, text_col, keep).drop("th")
    return d.mapInArrow(run, schema + kept_schema(d))


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return identify(docs, model, spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
