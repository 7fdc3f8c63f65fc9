"""Substring deduplication: long runs of words that an earlier document has are removed.

Method: suffix automata of reference shards.  An automaton accepts every stretch of
its shard's references; a document streamed through it gets its matching statistics,
the longest match that ends at each word, and every match of at least ``WINDOW``
words marks a span to remove.  ``remove_reference_spans`` broadcasts automata of a
given reference, whose size is checked.  ``substring_dedup`` has the whole corpus as
reference: stretches that can match are first brought together by the keys of their
windows (see ``runs``), equal stretches once each, and a shard is a set of keys; each
stretch is streamed through its shard's automaton of the documents before it, and
then added to it.

Defined results: null has no words; a document is compared with those of strictly
smaller id, so rows of one id leave each other alone and a null id comes last;
windows are judged on the input; an empty table gives no rows.  Columns are read by
the names given, others pass as told.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, buckets_for, chunks, documents, kept_schema, lasting, rows, sieve, sieved, staged, temporary, text_bytes, unsieved, with_kept
from .runs import covered, runs, spans

WINDOW = 50
GRAM = 8
#: Words of references in a shard, and the most that are broadcast.
SHARD_WORDS, MOST_BROADCAST_WORDS = 60_000, 400_000
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """All stretches of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            to = nxt[last].get(c)
            if to is not None:
                last = to if length[to] == length[last] + 1 else self._split(last, c, to)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def matches(self, sequence) -> list[int]:
        """For each place the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        at = n = 0
        out = []
        for c in sequence:
            to = nxt[at].get(c)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nxt[at].get(c)
            if to is not None:
                at, n = to, n + 1
            out.append(n)
        return out


def ends_to_windows(statistics: list[int], width: int) -> np.ndarray:
    """Which windows, by their starts, matched whole."""
    return np.asarray(statistics[width - 1 :], dtype=np.int64) >= width


def _run_rows(batches):
    hashes = WordHashes()
    for b in chunks(batches):
        split = [t.split() for t in text_bytes(b.column("text"))]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        own, start, n, key, g, _ = runs(hashes.of(list(chain.from_iterable(split))), sizes, WINDOW, GRAM)
        at = pa.array(own)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), pa.array(key.view(np.int64)), pa.array(g.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "th", "key", "g", "start", "n"])


def _cut(batches):
    """The words of the stretches listed for each document."""
    for b in chunks(batches):
        out = []
        for t, parts in zip(text_bytes(b.column("text")), b.column("parts").to_pylist(), strict=True):
            words = t.split()
            out += [(p["key"], p["g"], p["o"], b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "g", "o", "words"])


def _stream_shard(table: pa.Table) -> pa.Table:
    """Streams the stretches of a shard, by document, through the automaton of the documents before."""
    order = sorted(zip(*(table.column(c).to_pylist() for c in ("o", "key", "g", "words")), strict=True))
    number: dict[bytes, int] = {}
    automaton, waiting, now = SuffixAutomaton(), [], None
    out = []
    for o, key, g, words in order:
        if o != now:
            for s in waiting:
                automaton.add(s)
            waiting, now = [], o
        s = [number.setdefault(w, len(number)) for w in words.split(b" ")]
        hit = ends_to_windows(automaton.matches(s), WINDOW)
        if hit.any():
            out.append((key, g, spans(covered(hit, WINDOW))))
        waiting.append(s)
    return pa.table({"key": pa.array([x[0] for x in out], pa.int64()), "g": pa.array([x[1] for x in out], pa.int64()), "spans": pa.array([x[2] for x in out], pa.list_(pa.int32()))})


def removal(words: list[bytes], parts: list[dict] | None) -> tuple[int, bytes]:
    """How many words go and what is left, for spans given as (start, [from, to, ...])."""
    if not parts:
        return 0, b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for p in parts:
        s = p["spans"]
        for i, j in zip(s[::2], s[1::2], strict=True):
            gone[p["start"] + i : p["start"] + j] = True
    return int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])


def _remove(batches):
    for b in chunks(batches):
        out = []
        for t, parts in zip(text_bytes(b.column("text")), b.column("gone").to_pylist(), strict=True):
            words = t.split()
            out.append((len(words), *removal(words, parts)))
        yield with_kept(b, [b.column("doc_id"), b.column("th"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())], ["doc_id", "th", "n_words", "n_removed", "kept"])


def _keep(batches):
    """Texts that lose nothing."""
    return _remove(b.append_column("gone", pa.nulls(b.num_rows, pa.list_(pa.null()))) for b in batches)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_removed, kept (the words left, joined by one space)."""
    spark = docs.sparkSession
    d = rows(docs, id_col, text_col, keep)
    with temporary(spark):
        found = staged(d.select("doc_id", "th", "text").mapInArrow(_run_rows, "doc_id long, th long, key long, g long, start int, n int"), "runs")
        order = F.coalesce("doc_id", F.lit(LAST))
        # Equal stretches once each: the first document that has them, and whether others do.
        each = found.groupBy("key", "g").agg(F.min(F.struct(order.alias("o"), "th", "start", "n")).alias("first"), (F.min(order) != F.max(order)).alias("again"))
        of_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("again").alias("again")).where("kinds > 1 or again").select("key", "kinds")
        kept = staged(each.drop("again").join(of_key, "key").select("key", "g", "first.*", "kinds"), "stretches")
        # Only a key with unlike stretches needs the words compared.
        unlike = kept.where("kinds > 1")
        lists = unlike.groupBy("o", F.col("th").alias("th2")).agg(F.collect_list(F.struct("key", "g", "o", "start", "n")).alias("parts"))
        # Only texts that may be wanted are dealt out.
        some = sieved(d.select(F.xxhash64(order, "th").alias("h"), order.alias("o2"), "th", "text"), sieve(unlike.select(F.xxhash64("o", "th").alias("h")).distinct()))
        cut = some.join(lists, (some.o2 == lists.o) & (some.th == lists.th2)).select("text", "parts").mapInArrow(_cut, "key long, g long, o long, words binary")
        total = unlike.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
        shards = buckets_for(spark, total, SHARD_WORDS)
        shard = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(shards)).cast("int").alias("shard")
        judged = cut.select(shard, "key", "g", "o", "words").groupBy("shard").applyInArrow(_stream_shard, "key long, g long, spans array<int>")
        # A stretch goes whole where an earlier document has it, else as its first document's was judged.
        verdict = kept.join(judged, ["key", "g"], "left").select("key", "g", F.col("o").alias("first"), "spans")
        whole = F.array(F.lit(0), F.col("n") + F.lit(WINDOW - 1))
        hits = found.join(verdict, ["key", "g"]).withColumn("spans", F.when(order > F.col("first"), whole).otherwise(F.col("spans"))).where("spans is not null")
        gone = lasting(hits.groupBy(F.col("doc_id").alias("d2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("start", "spans")).alias("gone")), "gone")
    # Only texts that may lose something are dealt out to meet what they lose.
    schema = "doc_id long, th long, n_words long, n_removed long, kept string" + kept_schema(d)
    bits = sieve(gone.select(F.xxhash64("d2", "th2").alias("h")))
    d = d.withColumn("h", F.xxhash64("doc_id", "th"))
    whole = unsieved(d, bits, _keep, schema)
    some = sieved(d, bits)
    met = some.join(gone, some.doc_id.eqNullSafe(F.col("d2")) & (some.th == F.col("th2")), "left").drop("d2", "th2", "h")
    return whole.union(met.mapInArrow(_remove, schema))


def remove_reference_spans(docs: DataFrame, reference: list[str], width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of any window that one of the ``reference`` texts has; as substring_dedup."""
    words = [t.encode().split() for t in reference]
    if sum(map(len, words)) > MOST_BROADCAST_WORDS:
        raise ValueError(f"the reference has over {MOST_BROADCAST_WORDS} words; use substring_dedup on the union")
    shards, size = [SuffixAutomaton()], 0
    for w in words:
        if size > SHARD_WORDS:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(w)
        size += len(w)
    shared = docs.sparkSession.sparkContext.broadcast([(a.next, a.link, a.length) for a in shards])

    def run(batches):
        automata = []
        for parts in shared.value:
            a = SuffixAutomaton()
            a.next, a.link, a.length = parts
            automata.append(a)
        for b in chunks(batches):
            out = []
            for t in text_bytes(b.column("text")):
                own = t.split()
                gone = np.zeros(len(own), dtype=bool)
                if len(own) >= width:
                    for a in automata:
                        gone |= covered(ends_to_windows(a.matches(own), width), width)
                out.append((len(own), int(gone.sum()), b" ".join([w for w, x in zip(own, gone.tolist(), strict=True) if not x])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())], names=["doc_id", "th", "n_words", "n_removed", "kept"])

    return rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
