"""Byte-pair encoding and decoding with a public vocabulary whose words end in a marker.

Method: a short word is one row of two contiguous arrays, the parts between its
boundaries and the ranks of adjacent pairs.  The least rank is found by a scan,
its boundary is deleted (the row closes up), and the two ranks beside it are
refreshed; this repeats until no pair has a rank.  Rows of many words go through
numpy together.  A word over ``SHORT`` bytes takes the same merges in the same
order from a heap, so that its cost stays near linear.

Words seen of late keep their ids, at most ``most`` of them; this only saves work.

Defined results: null and empty texts have no ids and decode to the empty text;
control characters, marks and unpaired pieces are encoded byte by byte, so every
text has ids; the two special strings in a text are their own ids, as in the
library; repeated rows are encoded alike; null ids stay null; an empty table gives no
rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, documents, held, rows

TOKENIZER = "word_bpe_49k.json"
SHORT = 48
NONE = np.int32(2**31 - 1)
#: Fixed: how the vocabulary's normal text is split, with white space left out.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_WHITE = regex.compile(r"\p{White_Space}+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Pairs:
    """Open-addressing table from a pair of ids to its rank, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 6))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            win = first[free[first]]
            self.keys[slot[win]], self.ranks[slot[win]] = keys[todo[win]], todo[win]
            rest = np.ones(len(todo), dtype=bool)
            rest[win] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], NONE)
        more = np.flatnonzero((seen != keys) & (seen != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[more]]
            hit = seen == keys[more]
            out[more[hit]] = self.ranks[slot[more[hit]]]
            more = more[~hit & (seen != -1)]
        return out


class Encoder(dict):
    """Texts to ids and back.  As a dict it maps a white-space token to the slot of its ids."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        vocab, merges, end = table["model"]["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in table["model"]["merges"]], table["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in table["added_tokens"]}
        self.strings = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for k, v in chain(vocab.items(), self.special.items()):
            self.strings[v] = k
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        self.pairs = Pairs(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.slots = 0

    def __missing__(self, token: str) -> int:
        slot = self[token] = self.slots + len(self.new)
        self.new.append(token)
        return slot

    def _pieces(self, token: str) -> list[str]:
        if token.isascii():
            token = token.lower()
            return [token] if token.isalpha() else PIECES.findall(token)
        # One character at a time has no final sigma.
        return PIECES.findall(unicodedata.normalize("NFC", token).replace("Σ", "σ").lower())

    def _learn(self) -> None:
        """Give ids to the tokens that were new."""
        new, self.new = self.new, []
        pieces, owner, fixed = [], [], {}
        for k, t in enumerate(new):
            if t in self.special:
                fixed[k] = self.special[t]
                continue
            for p in self._pieces(t):
                pieces.append(p.encode())
                owner.append(k)
        ids, sizes = self.encode_words(pieces)
        own = np.repeat(np.asarray(owner, dtype=np.int64), sizes)
        if fixed:
            own = np.concatenate([own, np.fromiter(fixed, dtype=np.int64)])
            ids = np.concatenate([ids, np.fromiter(fixed.values(), dtype=np.int32)])
            order = np.argsort(own, kind="stable")
            own, ids = own[order], ids[order]
        count = np.bincount(own, minlength=len(new))
        self.flat = self._room(self.flat, self.used + len(ids))
        self.start, self.size = (self._room(x, self.slots + len(new)) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.slots : self.slots + len(new)] = self.used + np.cumsum(count) - count
        self.size[self.slots : self.slots + len(new)] = count
        self.used += len(ids)
        self.slots += len(new)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), dtype=x.dtype)])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in ((0, 6), (6, 10), (10, 16), (16, SHORT)):
            at = np.flatnonzero((length > low) & (length <= high))
            for k in range(0, len(at), 1 << 15):
                rows_ = at[k : k + (1 << 15)]
                found.append((rows_, *self._short([words[i] for i in rows_], length[rows_])))
        for i in np.flatnonzero(length > SHORT):
            ids = self._long(words[i])
            found.append((np.array([i]), np.array(ids, dtype=np.int32), np.array([len(ids)])))
        sizes = np.zeros(len(words), dtype=np.int64)
        for at, _, n in found:
            sizes[at] = n
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype=np.int32)
        for at, ids, n in found:
            out[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def _short(self, words: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(length.max())
        b = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        parts = self.inner[b]
        parts[np.arange(n), length - 1] = self.last[b[np.arange(n), length - 1]]
        cols = np.arange(width)
        parts[cols >= length[:, None]] = -1
        live = length.copy()
        done = np.full((n, width), -1, dtype=np.int32)
        ranks = np.full((n, width), NONE, dtype=np.int32)
        at = cols[:-1] < length[:, None] - 1
        ranks[:, :-1][at] = self.pairs(parts[:, :-1][at], parts[:, 1:][at])
        row = np.arange(n)
        while len(row):
            m = ranks.argmin(axis=1)
            best = ranks[np.arange(len(m)), m]
            go = best != NONE
            if not go.all():
                done[row[~go]] = parts[~go]
                row, parts, ranks, m, best = row[go], parts[go], ranks[go], m[go], best[go]
                if not len(row):
                    break
            r = np.arange(len(row))
            # Delete the boundary after part m: what is behind it moves up by one.
            behind = cols[:-1] > m[:, None]
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            parts[:, -1], ranks[:, -1] = -1, NONE
            parts[r, m] = self.merged[best]
            live[row] -= 1
            # Refresh the ranks on both sides.
            ranks[r, m] = NONE
            right = np.flatnonzero(m < live[row] - 1)
            ranks[right, m[right]] = self.pairs(parts[right, m[right]], parts[right, m[right] + 1])
            left = np.flatnonzero(m > 0)
            ranks[left, m[left] - 1] = self.pairs(parts[left, m[left] - 1], parts[left, m[left]])
        return done[cols < live[:, None]], live

    def _long(self, word: bytes) -> list[int]:
        ids = [*self.inner[np.frombuffer(word[:-1], dtype=np.uint8)].tolist(), int(self.last[word[-1]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := self.rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or self.rank.get((ids[k], ids[j])) != r:
                continue
            ids[k], ids[j] = int(self.merged[r]), -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := self.rank.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := self.rank.get((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (x, before[k]))
        return [x for x in ids if x >= 0]

    def _tokens(self, text: str) -> list[str]:
        if "<|" in text:
            for s in self.special:
                text = text.replace(s, f" {s} ")
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in _WHITE.split(text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end."""
        if self.slots > self.most:
            self._reset()
        tokens = [self._tokens(t) for t in texts]
        count = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        slots = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(count.sum()))
        if self.new:
            self._learn()
        n = self.size[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[slots] - (ends - n), n) + np.arange(total)]
        edge = np.concatenate([[0], ends])
        return ids, edge[np.cumsum(count)]

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def encoder(tokenizer: str) -> Encoder:
    """The encoder of a vocabulary file, or of a public one by its name; a worker keeps it while its tasks ask for it."""
    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return held(("bpe", tokenizer), lambda: Encoder(tokenizer))


def texts_of(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document: doc_id, th, ids."""

    def run(batches):
        e = encoder(tokenizer)
        for b in chunks(batches):
            ids, ends = e.encode(texts_of(b.column("text")))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "th", "ids"])

    return rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, th and decoded text of rows that bpe_encode made; null ids decode to the empty text."""

    def run(batches):
        e = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([e.decode(x or ()) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "th", "decoded"])

    return encoded.select("doc_id", "th", "ids").mapInArrow(run, "doc_id long, th long, decoded string")


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Encode and decode where the text is: n_tokens and SHA-256 of the ids (little-endian, 32 bits) and of the decoded text."""

    def run(batches):
        e = encoder(tokenizer)
        for b in chunks(batches):
            ids, ends = e.encode(texts_of(b.column("text")))
            raw, begin, out = ids.astype("<u4"), 0, []
            for end in ends.tolist():
                own = raw[begin:end]
                out.append((end - begin, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(e.decode(own.tolist()).encode()).hexdigest()))
                begin = end
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir))
