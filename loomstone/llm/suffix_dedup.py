"""Exact byte deduplication with suffix arrays built by external induced sorting.

Method: induced sorting of suffixes in the manner of external-memory builders.  The
suffixes that start a falling-to-rising turn are sorted through a reduced string of
their names, which is sorted by recursion (by doubling in memory up to ``BASE``
names); all others are induced from them in one ascending and one descending pass.
In a pass a priority queue by first character holds tuples of a suffix and its common
prefix with the one before it; what is popped for a character induces the tuples of
its left neighbours, whole arrays at a time, with the least common prefix popped
between two of them and one more character.  Queue contents beyond ``QUEUE_BYTES``
lie in an unlinked file of the task's own temporary folder.  The turns' own common
prefixes are read off rolling hashes; a window repeats where a prefix reaches it.

Stretches that can match are brought together first by the keys of their windows
(see ``runs``), equal ones once each with their number; a shard is a set of keys, and
sorts those of its stretches that share a piece around their key's gram.

Defined results: null is empty; a text under ``WINDOW`` bytes loses nothing; of a
text with a copy every byte goes, in both; what is left of a text is raw bytes and
may break characters apart; null and repeated ids are documents like others; an empty
table gives no rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

import functools
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, chunks, documents, lasting, mixed, rows, sieve, sieved, staged, temporary, text_bytes
from .runs import Rolling, covered, meeting, runs, spans

WINDOW = 400
GRAM = 32
SHARD_BYTES = 2 << 20
QUEUE_BYTES = 4 << 20
#: Bytes of texts that are searched for runs at once: some twenty arrays of eight bytes each.
RUN_BYTES = 1 << 20
#: Reduced strings up to this length are sorted in memory.
BASE = 1 << 24


class Queue:
    """Tuples (suffix, common prefix with the one before) by first character, first in first out; beyond a number of bytes they go to a file."""

    def __init__(self, symbols: int, most: int = QUEUE_BYTES):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.most, self.file = 0, most, None

    def push(self, chars: np.ndarray, tuples: np.ndarray) -> None:
        """Adds ``tuples`` to the queues of ``chars``, which are sorted."""
        if not len(chars):
            return
        edge = np.concatenate([[0], np.flatnonzero(np.diff(chars)) + 1, [len(chars)]]).tolist()
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            self._put(int(chars[i]), tuples[i:j])

    def _put(self, c: int, part: np.ndarray) -> None:
        self.held += part.nbytes
        if self.held > self.most:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(np.ascontiguousarray(part).tobytes())
            self.held -= part.nbytes
            part = (at, len(part))
        self.parts[c].append(part)

    def take(self, c: int) -> np.ndarray:
        """All that is in the queue of ``c`` now; it is empty after."""
        parts, self.parts[c] = self.parts[c], []
        out = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                p = np.frombuffer(self.file.read(8 * p[1]), dtype=np.int32).reshape(-1, 2)
            else:
                self.held -= p.nbytes
            out.append(p)
        return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int32)


def _doubling(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string in memory, by doubling the sorted length."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    # The rank of a suffix is the first place of its group; only places of groups of several are sorted on.
    rank, places, step, key = np.zeros(n + 1, dtype=np.int64), np.arange(n), 1, t[order]
    while True:
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[places]] = places[np.flatnonzero(new)][np.cumsum(new) - 1] + 1
        places = places[~(new & np.append(new[1:], True))]
        if not len(places):
            return order.astype(np.int32)
        at = order[places]
        key = rank[at] << 32 | rank[np.minimum(at + step, n)]
        by = np.argsort(key)
        order[places], key = at[by], key[by]
        step *= 2


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the one after it; the last symbol is the least and only one of its kind."""
    change = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(change != 0, np.arange(len(change)), len(change))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(change, -1)[following] > 0, True)


FAR = (1 << 31) - 2


class _Pass:
    """One pass of induction: what is popped pushes its left neighbours of one type, each with its common prefix.

    Two tuples that follow each other in a queue stem from two that were popped; what
    the popped ones have in common, and so one more character for the new ones, is the
    least common prefix popped between them.
    """

    def __init__(self, t: np.ndarray, rising: np.ndarray, rise: bool, symbols: int, carry: bool):
        self.t, self.rising, self.rise, self.queue = t, rising, rise, Queue(symbols)
        # The least common prefix popped since the last push, for each character.
        self.least = np.zeros(symbols, dtype=np.int64) if carry else None

    def pop(self, wave: np.ndarray) -> None:
        suffix, prefix = wave[:, 0], wave[:, 1]
        at = np.flatnonzero(suffix > 0)
        at = at[self.rising[suffix[at] - 1] == self.rise]
        before = suffix[at] - 1
        chars = self.t[before]
        by = np.argsort(chars, kind="stable")
        at, before, chars = at[by], before[by], chars[by]
        new = np.zeros((len(at), 2), dtype=np.int32)
        new[:, 0] = before
        if self.least is not None and len(wave):
            self._carry(prefix, at, chars, new)
        self.queue.push(chars, new)

    def _carry(self, prefix: np.ndarray, at: np.ndarray, chars: np.ndarray, new: np.ndarray) -> None:
        head = np.ones(len(at), dtype=bool)
        head[1:] = chars[1:] != chars[:-1]
        begin = np.where(head, 0, np.concatenate([[0], at[:-1] + 1])) if len(at) else at
        padded = np.append(prefix, FAR).astype(np.int64)
        low = np.minimum.reduceat(padded, np.stack([begin, at + 1], axis=1).ravel())[::2] if len(at) else padded[:0]
        own = chars[head]
        low[head] = np.minimum(low[head], self.least[own])
        new[:, 1] = np.minimum(low + 1, FAR)
        np.minimum(self.least, prefix.min(), out=self.least)
        last = np.append(head[1:], True) if len(at) else head
        self.least[own] = np.minimum.reduceat(padded, np.stack([at[last] + 1, np.full(int(last.sum()), len(prefix))], axis=1).ravel())[::2] if len(at) else 0
        self.least[own[at[last] + 1 >= len(prefix)]] = FAR

    def drain(self, c: int) -> np.ndarray:
        """All of the queue of ``c``, popped wave by wave: a wave can push into the same queue."""
        own, wave = [], self.queue.take(c)
        wave[:1, 1] = 0  # nothing before it begins with this character
        while len(wave):
            own.append(wave)
            self.pop(wave)
            wave = self.queue.take(c)
        return np.concatenate(own) if own else wave


def _repeats(t: np.ndarray) -> np.ndarray:
    """How often the character at each place is repeated from there on."""
    change = np.append(np.flatnonzero(np.diff(t)), len(t) - 1)
    return np.repeat(change, np.diff(change, prepend=-1)) - np.arange(len(t)) + 1


def _seam(repeats: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """What the last falling and the first rising suffix of a character have in common: the character, as often as both repeat it."""
    return int(min(repeats[left[0]], repeats[right[0]]))


def _induce(t: np.ndarray, rising: np.ndarray, turns: np.ndarray, symbols: int, prefixes: np.ndarray | None = None) -> np.ndarray:
    """Tuples of all suffixes in order from the order of the turns, through queues by character.

    With ``prefixes``, the turns' common prefixes, every tuple has that of its suffix
    with the one before it; else zero.
    """
    carry = prefixes is not None
    known = np.zeros((len(turns), 2), dtype=np.int32)
    known[:, 0] = turns
    repeats = _repeats(t) if carry else None
    if carry and len(turns):
        known[:, 1] = prefixes
    starts = np.searchsorted(t[turns], np.arange(symbols + 1)) if len(turns) else np.zeros(symbols + 1, dtype=np.int64)
    falling, up = [], _Pass(t, rising, False, symbols, carry)
    for c in range(symbols):  # ascending: the falling suffixes
        falling.append(up.drain(c))
        own = known[starts[c] : starts[c + 1]]
        if len(own):
            if carry:
                own[0, 1] = _seam(repeats, falling[c][-1], own[0]) if len(falling[c]) else 0
            up.pop(own)
    out, down = [], _Pass(t, rising, True, symbols, carry)
    for c in range(symbols - 1, -1, -1):  # descending: the rising ones; a tuple's prefix is with the one after it
        own = down.drain(c)
        if c == 0:
            own = np.concatenate([own, np.array([[len(t) - 1, 0]], dtype=np.int32)])  # the end is the least suffix
        rest = falling[c][::-1].copy()
        if carry and len(rest):
            rest[1:, 1] = rest[:-1, 1].copy()
            rest[0, 1] = _seam(repeats, rest[0], own[-1]) if len(own) else 0
        down.pop(rest)
        falling[c] = None
        out += [own, rest]
    all_ = np.concatenate(out)[::-1].copy()
    all_[1:, 1] = all_[:-1, 1].copy()
    all_[0, 1] = 0
    return all_


def suffix_order(t: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes of ``t`` in order; symbol 0 is only its last."""
    if len(t) < 64:
        return _doubling(t)
    rising = _types(t)
    return _induce(t, rising, _sorted_turns(t, rising, symbols), symbols)[:, 0]


def suffix_prefixes(t: np.ndarray, symbols: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_order`` and the common prefix of each suffix with the one before it, exact below ``cap``.

    The turns' common prefixes are read off rolling hashes; the queues carry them on
    to all others.
    """
    if len(t) < 64:
        order = _doubling(t)
        return order, common_prefixes(t, order, cap)
    rising = _types(t)
    turns = _sorted_turns(t, rising, symbols)
    all_ = _induce(t, rising, turns, symbols, common_prefixes(t, turns, cap) if len(turns) else np.zeros(0, dtype=np.int64))
    return all_[:, 0], all_[:, 1]


def _sorted_turns(t: np.ndarray, rising: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes that begin where falling turns to rising, in order, through the reduced string of their names."""
    n = len(t)
    turns = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(np.int32)
    if len(turns) < 2:
        return turns
    # Names: a pass from turns in any order sorts the stretches from turn to turn.
    rough = _induce(t, rising, turns[np.argsort(t[turns], kind="stable")], symbols)[:, 0]
    is_turn = np.zeros(n, dtype=bool)
    is_turn[turns] = True
    by = rough[is_turn[rough]]
    end = np.append(turns[1:], n - 1)
    place = np.zeros(n, dtype=np.int64)
    place[turns] = np.arange(len(turns))
    h = Rolling(mixed(t.astype(np.uint64), 13)).stretches(turns.astype(np.int64), end.astype(np.int64) + 1)
    own = h[place[by]]
    name = np.cumsum(np.concatenate([[True], own[1:] != own[:-1]]))
    reduced = np.empty(len(turns), dtype=np.int64)
    reduced[place[by]] = name
    if name[-1] == len(turns):
        return turns[np.argsort(reduced)]
    return turns[_doubling(reduced) if len(reduced) <= BASE else suffix_order(np.append(reduced, 0), int(name[-1]) + 1)[1:]]


def common_prefixes(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Length of the prefix that each suffix in the order has in common with the one before it, at most ``cap``."""
    r = Rolling(mixed(t.astype(np.uint64), 13))
    a, b = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    out, go = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    low, high = out.copy(), np.minimum(cap, len(t) - np.maximum(a, b))
    m = high  # first whether all is common, as in what repeats
    while len(go):
        same = r.alike(a, b, m)
        low, high = np.where(same, m, low), np.where(same, high, m - 1)
        done = low >= high
        out[go[done]] = low[done]
        go, a, b, low, high = (x[~done] for x in (go, a, b, low, high))
        m = (low + high + 1) // 2
    return np.append(0, out)


def repeated(parts: list[bytes], width: int = WINDOW) -> list[np.ndarray]:
    """For each part, which of its windows of ``width`` bytes start anywhere else in the parts too."""
    if not parts:
        return []
    t = np.frombuffer(b"\0".join(parts) + b"\0\0", dtype=np.uint8).astype(np.int16)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begin = np.cumsum(size + 1) - (size + 1)
    inside = np.zeros(len(t), dtype=bool)
    inside[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = True
    t = np.where(inside, t + 2, 1)  # byte b is symbol b + 2, a part's end is 1
    t[-1] = 0
    order, prefixes = suffix_prefixes(t, 258, width)
    long_ = prefixes >= width
    hit = np.zeros(len(t), dtype=bool)
    hit[order[long_]] = True
    hit[order[np.append(long_[1:], False)]] = True
    return [hit[b : b + n - width + 1] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return mixed(np.arange(256, dtype=np.uint64), 17)


def _run_rows(batches):
    for b in chunks(batches, most=RUN_BYTES):
        texts = text_bytes(b.column("text"))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        own, start, n, key, g, twice = runs(_symbols()[np.frombuffer(b"".join(texts), dtype=np.uint8)], sizes, WINDOW, GRAM)
        at = pa.array(own)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), pa.array(key.view(np.int64)), pa.array(g.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["doc_id", "th", "key", "g", "start", "n", "twice"])


def _cut(batches):
    for b in chunks(batches):
        out = []
        for t, parts in zip(text_bytes(b.column("text")), b.column("parts").to_pylist(), strict=True):
            out += [(p["key"], p["g"], t[p["start"] : p["start"] + p["n"] + WINDOW - 1]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "g", "bytes"])


def _sort_shard(table: pa.Table) -> pa.Table:
    # A row that the input repeats is cut once for each; it counts once here.
    once = {(k, g): s for k, g, s in zip(*(table.column(c).to_pylist() for c in ("key", "g", "bytes")), strict=True)}
    sizes = np.fromiter(map(len, once.values()), dtype=np.int64, count=len(once))
    keys = np.fromiter((k for k, _ in once), dtype=np.int64, count=len(once)).view(np.uint64)
    may = meeting(_symbols()[np.frombuffer(b"".join(once.values()), dtype=np.uint8)], sizes, keys, WINDOW, GRAM)
    once = {k: s for (k, s), m in zip(once.items(), may.tolist(), strict=True) if m}
    out = [(k, g, spans(covered(hit, WINDOW))) for (k, g), hit in zip(once, repeated(list(once.values())), strict=True) if hit.any()]
    return pa.table({"key": pa.array([x[0] for x in out], pa.int64()), "g": pa.array([x[1] for x in out], pa.int64()), "spans": pa.array([x[2] for x in out], pa.list_(pa.int32()))})


def _remove(batches):
    for b in chunks(batches):
        out = []
        for t, parts in zip(text_bytes(b.column("text")), b.column("gone").to_pylist(), strict=True):
            if not parts:
                out.append((len(t), 0, 0, t))
                continue
            gone = np.zeros(len(t), dtype=bool)
            for p in parts:
                for i, j in zip(p["spans"][::2], p["spans"][1::2], strict=True):
                    gone[p["start"] + i : p["start"] + j] = True
            out.append((len(t), int(gone.sum()), len(spans(gone)) // 2, np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    spark = docs.sparkSession
    d = rows(docs, id_col, text_col)
    with temporary(spark):
        found = staged(d.mapInArrow(_run_rows, "doc_id long, th long, key long, g long, start int, n int, twice boolean"), "runs")
        each = found.groupBy("key", "g").agg(F.min(F.struct("doc_id", "th", "start", "n", "twice")).alias("first"), F.count(F.lit(1)).alias("times"))
        of_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("times").alias("most"), F.max("first.twice").alias("self")).where("kinds > 1 or most > 1 or self")
        kept = staged(each.join(of_key.select("key", (F.col("kinds") > 1).alias("unlike"), "self"), "key").select("key", "g", "first.*", "times", (F.col("unlike") | F.col("self")).alias("look")), "stretches")
        look = kept.where("look")
        lists = look.groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("key", "g", "start", "n")).alias("parts"))
        # Only texts that may be wanted are dealt out.
        key = F.xxhash64("doc_id", "th").alias("h")
        some = sieved(d.select(key, "doc_id", "th", "text"), sieve(look.select(key).distinct()))
        cut = some.join(lists, some.doc_id.eqNullSafe(F.col("d2")) & (some.th == F.col("th2"))).select("text", "parts").mapInArrow(_cut, "key long, g long, bytes binary")
        total = look.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
        shards = buckets_for(spark, total, SHARD_BYTES)
        shard = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(shards)).cast("int").alias("shard")
        judged = cut.select(shard, "key", "g", "bytes").groupBy("shard").applyInArrow(_sort_shard, "key long, g long, spans array<int>")
        verdict = kept.join(judged, ["key", "g"], "left").select("key", "g", "times", "spans")
        whole = F.array(F.lit(0), F.col("n") + F.lit(WINDOW - 1))
        hits = found.join(verdict, ["key", "g"]).withColumn("spans", F.when(F.col("times") > 1, whole).otherwise(F.col("spans"))).where("spans is not null")
        gone = lasting(hits.groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("start", "spans")).alias("gone")), "gone")
    out = d.join(gone, d.doc_id.eqNullSafe(F.col("d2")) & (d.th == F.col("th2")), "left").select("doc_id", "th", "text", "gone")
    return out.mapInArrow(_remove, "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
