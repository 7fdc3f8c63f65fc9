"""Similarity join of word shingles by Jaccard similarity, exact, with classes of linked documents.

Method: multiple-global-order filtering.  Under any order of the tokens, two sets
that overlap in ``o`` tokens share their first k common tokens within prefixes of
n - o + k tokens.  The first order is applied to all documents, with longer
prefixes of which a certain number must be shared with others.  A second order has rare
tokens first, so that what has only a common passage in common shares no prefix token;
it groups what is left into families.  Within a family a pair is a candidate if it shares a prefix token under each of
``ORDERS``: their lists are intersected, and only what is left has its sets compared.
Sets equal to each other are one class throughout, so copies cost one member.

Within a family, links are followed outwards from one set at a time; each set is
compared once, with the sets not reached so far.  Large families are dealt out (see
``families``).  Links never leave the tasks one by one: a task gives each of its sets
the least one it is connected to.

Defined results: a document without words (null, empty or blank) has no shingles,
no links and itself as component; fewer than five words are one shingle; rows of
equal sets are linked; a null id is never a component's least id unless all are null; an empty table gives no
rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, buckets_for, chunks, documents, grams, lasting, let_go, mixed, rows, sieve, sieved, staged, sweep, temporary, text_bytes
from .components import components
from .families import linked_families

WORDS = 5
#: Percent of the union that the intersection must have.
LIKE = 80
TOKENS_A_BUCKET = 1_000_000
#: Tokens of candidates that are counted at once.
COUNTED = 4_000_000
#: The global orders under which a pair must share prefix tokens before its sets are compared.
RARE = -1
ORDERS = (RARE, 0, 2)
#: Cells of an order by frequencies of hashed tokens.
CELL_BITS = 22


def least_overlap(n):
    """Of a set of n tokens with any set that it is linked to."""
    return -(-n * LIKE // 100)


def shingle_sets(texts: list[bytes], hashes: WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending: their order is the first global order."""
    split = [t.lower().split() for t in texts]
    size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    h = hashes.of(list(chain.from_iterable(split)))
    g = mixed(grams(h, words), 1)
    out, at = [], 0
    for n in size.tolist():
        if n >= words:
            out.append(np.unique(g[at : at + n - words + 1]))
        elif n:
            out.append(mixed(grams(h[at : at + n], n) + np.uint64(n), 8))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return (int(mixed(s, 11).sum(dtype=np.uint64).view(np.int64)), int(mixed(s, 12).sum(dtype=np.uint64).view(np.int64))) if len(s) else (0, 0)


def _sets(batches):
    """Each document's number of shingles and signature."""
    let_go()
    hashes = WordHashes()
    for b in chunks(batches):
        own = shingle_sets(text_bytes(b.column("text")), hashes)
        sig = [signature(s) for s in own]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(map(len, own), pa.int64()), *(pa.array([x[k] for x in sig], pa.int64()) for k in (0, 1))], names=["doc_id", "th", "n", "s1", "s2"])


def _whole_sets(batches):
    let_go()
    hashes = WordHashes()
    for b in chunks(batches):
        own = shingle_sets(text_bytes(b.column("text")), hashes)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("s1", "s2", "n")), pa.array([s.tobytes() for s in own], pa.binary())], names=["s1", "s2", "n", "tokens"])


def ordered(tokens: np.ndarray, order: int) -> np.ndarray:
    """A set under another global order: its tokens renamed by a bijection, ascending; order 0 is their own."""
    return np.sort(mixed(tokens, 20 + order) if order else tokens)


def prefix(s: np.ndarray, order: int, more: int = 0) -> np.ndarray:
    """The tokens among which a set has one, and up to ``more`` others, in common with any set that it is linked to."""
    return ordered(s, order)[: len(s) - least_overlap(len(s)) + 1 + more]


def _blobs(sigs: list[int], own: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """Sets as blobs of (token, signature) by bucket of tokens."""
    token, doc = np.concatenate(own), np.repeat(np.arange(len(own)), np.fromiter(map(len, own), dtype=np.int64))
    bucket = (mixed(token, 9) % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    token, doc, bucket = token[by], doc[by], bucket[by]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    sig = np.array(sigs, dtype=np.int64)
    out = []
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        d = doc[i:j]
        first = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        count = np.diff(np.append(first, len(d)))
        out.append((int(bucket[i]), token[i:j].tobytes(), sig[d[first]].tobytes(), count.astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "sigs", "counts"])


BLOBS = "bucket int, tokens binary, sigs binary, counts binary"


def _first_prefixes(n_buckets: int):
    """Long prefixes under the first order, from the texts; a set that the task has just seen is not sent again."""

    def run(batches):
        let_go()
        hashes, seen = WordHashes(), set()
        for b in chunks(batches):
            sigs, own = [], []
            for s in shingle_sets(text_bytes(b.column("text")), hashes):
                if not len(s) or (x := signature(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(x)
                sigs.append(x[0])
                own.append(prefix(s, 0, len(s) // 8))
            if own:
                yield _blobs(sigs, own, n_buckets)

    return run


def _prefixes(orders: Orders, n_buckets: int):
    def run(batches):
        for b in batches:
            sets = [np.frombuffer(t, dtype=np.uint64) for t in b.column("tokens").to_pylist()]
            if sets:
                yield _blobs(b.column("s1").to_pylist(), [orders.prefix(s, RARE) for s in sets], n_buckets)

    return run


def _all_tokens(n_buckets: int):
    def run(batches):
        for b in batches:
            sets = [np.frombuffer(t, dtype=np.uint64) for t in b.column("tokens").to_pylist()]
            if sets:
                yield _blobs(b.column("s1").to_pylist(), sets, n_buckets)

    return run


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens, 40) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Orders:
    """Global orders of the tokens: that of their hashes, others by bijections of these, and rare ones first.

    Any order is right, and one that has frequent tokens last keeps what has only a
    common passage in common apart.  Sets come with their rare tokens first, or
    ``levels`` has frequencies of cells of hashed tokens, which larger inputs blur.
    """

    def __init__(self, levels: np.ndarray | None = None):
        self.levels = levels

    def prefix(self, s: np.ndarray, order: int) -> np.ndarray:
        """The tokens among which a set has one in common with any set that it is linked to."""
        n = len(s) - least_overlap(len(s)) + 1
        if order != RARE:
            return prefix(s, order)
        if self.levels is None:
            return s[:n]
        return s[np.lexsort((mixed(s, 41), self.levels[_cell(s)]))[:n]]


def _found_again(token: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose token has a neighbour with the same token."""
    same = token[1:] == token[:-1]
    keep = np.zeros(len(token), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return token[keep], sig[keep]


def _common(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The (token, s1) pairs of a bucket whose token has at least two sets, sorted."""
    token = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()])
    sig = np.concatenate([np.repeat(np.frombuffer(s, dtype=np.int64), np.frombuffer(c, dtype=np.uint32)) for s, c in zip(table.column("sigs").to_pylist(), table.column("counts").to_pylist(), strict=True)])
    by = np.argsort(token, kind="stable")
    token, sig = token[by], sig[by]
    for _ in range(2):  # first tokens found once go, then pairs found again, then tokens of one set
        token, sig = _found_again(token, sig)
        by = np.lexsort((sig, token))
        token, sig = token[by], sig[by]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig = token[new], sig[new]
    return _found_again(token, sig)


def _shared_counts(parts: int):
    """How many shared tokens of a bucket each set has, dealt out by set: one row for each part, not for each set."""

    def run(table: pa.Table) -> pa.Table:
        sig, count = np.unique(_common(table)[1], return_counts=True)
        part = (mixed(sig.view(np.uint64), 10) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        sig, count, part = sig[by], count[by].astype(np.int64), part[by]
        edge = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]]).tolist()
        return pa.table({"part": pa.array(part[edge[:-1]], pa.int32()), "sigs": pa.array([sig[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary()), "counts": pa.array([count[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary())})

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    sig, count = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in ("sigs", "counts"))
    sig, at = np.unique(sig, return_inverse=True)
    return pa.table({"s1": pa.array(sig), "shared": pa.array(np.bincount(at, weights=count, minlength=len(sig)).astype(np.int64))})


def _part(sig: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(sig.view(np.uint64), 10) % np.uint64(parts)).astype(np.int64)


def _token_counts(parts: int):
    """Of a bucket the tokens of at least two sets and their number of sets, dealt out by set: one row for each part."""

    def run(table: pa.Table) -> pa.Table:
        token, sig = _common(table)
        _, number, count = np.unique(token, return_inverse=True, return_counts=True)
        part = _part(sig, parts)
        by = np.lexsort((token, sig, part))
        token, sig, part, count = token[by], sig[by], part[by], count[number][by].astype(np.uint32)
        edge = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]]).tolist()
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary())
        return pa.table({"part": pa.array(part[edge[:-1]], pa.int32()), "sigs": cut(sig), "shared": cut(token), "counts": cut(count)})

    return run


def _parts(parts: int):
    """Sets with the part that the counts of their tokens go to."""

    def run(batches):
        for b in batches:
            part = _part(np.asarray(b.column("s1"), dtype=np.int64), parts)
            yield pa.RecordBatch.from_arrays([b.column("s1"), b.column("tokens"), pa.array(part, pa.int32())], names=["s1", "tokens", "part"])

    return run


def _rare_first(sets: pa.Table, found: pa.Table) -> pa.Table:
    """The sets of a part with their tokens by the number of sets that have them: those of one set only come first."""
    sig, shared, count = (np.frombuffer(b"".join(found.column(c).to_pylist()), dtype=kind) for c, kind in (("sigs", np.int64), ("shared", np.uint64), ("counts", np.uint32)))
    by = np.argsort(sig, kind="stable")
    sig, shared, count = sig[by], shared[by], count[by]
    own = np.asarray(sets.column("s1").combine_chunks() if sets.num_rows else [], dtype=np.int64)
    first, last = np.searchsorted(sig, own), np.searchsorted(sig, own, side="right")
    out = []
    for t, i, j in zip(sets.column("tokens").to_pylist(), first.tolist(), last.tolist(), strict=True):
        s = np.frombuffer(t, dtype=np.uint64)
        n = np.ones(len(s), dtype=np.uint32)
        n[np.searchsorted(s, shared[i:j])] = count[i:j]
        out.append(s[np.lexsort((mixed(s, 41), n))].tobytes())
    return pa.table({"s1": pa.array(own, pa.int64()), "tokens": pa.array(out, pa.binary())})


def rare_first(spark, whole: DataFrame, total: int) -> DataFrame:
    """s1 and tokens of all sets, the tokens of fewest sets first.

    Counts are exact, whatever the number of tokens: a token of one set, of which there
    are most, never passes for a frequent one nor the other way.
    """
    n = buckets_for(spark, total, TOKENS_A_BUCKET)
    counts = whole.select("s1", "tokens").mapInArrow(_all_tokens(n), BLOBS).groupBy("bucket").applyInArrow(_token_counts(n), "part int, sigs binary, shared binary, counts binary")
    sets = whole.select("s1", "tokens").mapInArrow(_parts(n), "s1 long, tokens binary, part int")
    return sets.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_rare_first, "s1 long, tokens binary")


def _stars(table: pa.Table) -> pa.Table:
    """Each set of a token with the least set of that token: a row for each, never all pairs."""
    token, sig = _common(table)
    if not len(token):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    head = np.concatenate([[True], token[1:] != token[:-1]])
    lead = sig[np.flatnonzero(head)][np.cumsum(head) - 1]
    pair = np.unique(np.stack([sig, lead], axis=1)[sig != lead], axis=0)
    return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})


class Family:
    """Sets that may be linked: the lists of an order have the sets of each prefix token."""

    def __init__(self, sets: list[np.ndarray], orders: Orders):
        self.size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        self.start = np.append(0, np.cumsum(self.size))
        _, self.token = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.token.max()) + 1, dtype=bool)
        self.open = np.ones(len(sets), dtype=bool)
        self.lists = [self._lists([orders.prefix(s, order) for s in sets]) for order in ORDERS]

    @staticmethod
    def _lists(own: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        doc = np.repeat(np.arange(len(own)), size)
        _, number, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        used = count[number] > 1  # a token of one set tells nothing
        doc, number = doc[used], number[used]
        by = np.argsort(number, kind="stable")
        return number, np.searchsorted(doc, np.arange(len(own) + 1)), doc[by], np.searchsorted(number[by], np.arange(len(count) + 1))

    def candidates(self, k: int) -> np.ndarray:
        """Open sets that share a prefix token with set k under every order."""
        left = self.open
        for number, own, docs, start in self.lists:
            t = number[own[k] : own[k + 1]]
            begin, n = start[t], start[t + 1] - start[t]
            met = np.zeros(len(self.size), dtype=bool)
            met[docs[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
            left = left & met
            if not left.any():
                break
        return np.flatnonzero(left)

    def linked(self, k: int) -> np.ndarray:
        """The open sets that are linked with set k."""
        found = self.candidates(k)
        if not len(found):
            return found
        own = self.token[self.start[k] : self.start[k + 1]]
        self.mark[own] = True
        both, at = np.empty(len(found), dtype=np.int64), 0
        ends = np.cumsum(self.size[found])
        while at < len(found):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, side="right")))
            n = self.size[found[at:to]]
            first = np.cumsum(n) - n
            both[at:to] = np.add.reduceat(self.mark[self.token[np.repeat(self.start[found[at:to]] - first, n) + np.arange(int(n.sum()))]], first, dtype=np.int64)
            at = to
        self.mark[own] = False
        return found[100 * both >= LIKE * (self.size[k] + self.size[found] - both)]


def link(sigs: list[int], blobs: list[bytes], orders: Orders) -> list[tuple[int, int]]:
    """(signature, the least signature it is connected to) within a family of distinct sets."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs]
    order = sorted(range(len(sigs)), key=lambda k: sigs[k])
    family, out = Family([sets[k] for k in order], orders), []
    for first in range(len(order)):
        if not family.open[first]:
            continue
        family.open[first] = False
        front = [first]
        while front:
            near = family.linked(front.pop())
            family.open[near] = False
            front += near.tolist()
            out += [(sigs[order[k]], sigs[order[first]]) for k in near.tolist()]
    return out


def _links(spark, d: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``node`` and ``component``, as signatures, of all sets that are linked."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    # First order: of a linked set's prefix at least a tenth of the set is shared with others.
    n_buckets = buckets_for(spark, total / 3, TOKENS_A_BUCKET)
    parts = d.select("text").mapInArrow(_first_prefixes(n_buckets), BLOBS).groupBy("bucket").applyInArrow(_shared_counts(n_buckets), "part int, sigs binary, counts binary")
    count = parts.groupBy("part").applyInArrow(_add_counts, "s1 long, shared long")
    left = classes.join(count, "s1").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    key = F.xxhash64("doc_id", "th").alias("h")
    left = staged(left.select("s1", "s2", "n", F.col("rep.doc_id").alias("rid"), F.col("rep.th").alias("rth")), "left")
    del parts, count
    sweep(spark)  # the prefixes of all documents are not needed any more
    # Only texts that may be wanted are dealt out.
    some = sieved(d.select(key, "doc_id", "th", "text"), sieve(left.select(F.xxhash64("rid", "rth").alias("h"))))
    found = some.join(left, some.doc_id.eqNullSafe(F.col("rid")) & (some.th == F.col("rth"))).select("s1", "s2", "n", "text")
    with temporary(spark):
        whole = staged(found.mapInArrow(_whole_sets, "s1 long, s2 long, n long, tokens binary"), "whole")
        del some, found
        sweep(spark)  # nor the texts that were dealt out
        total = whole.agg(F.sum("n")).first()[0] or 0
        whole = lasting(rare_first(spark, whole, total), "ordered")
    # Second order, rare tokens first: families.
    orders = Orders()
    n_buckets = buckets_for(spark, total / 5, TOKENS_A_BUCKET)
    stars = whole.select("s1", "tokens").mapInArrow(_prefixes(orders, n_buckets), BLOBS).groupBy("bucket").applyInArrow(_stars, "a long, b long")
    family = components(stars).select("node", F.col("component").alias("family"))
    members = staged(family.join(family.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "family").select("node", "family", "members"), "members")
    return linked_families(members, whole.select(F.col("s1").alias("node"), F.col("tokens").alias("body")), functools.partial(link, orders=orders))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th, n_shingles, component_id, group_key (equal for the documents of one component, of null ids too; null without words)."""
    spark = docs.sparkSession
    d = rows(docs, id_col, text_col)
    sets = staged(d.mapInArrow(_sets, "doc_id long, th long, n long, s1 long, s2 long"), "sets")
    classes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
    with temporary(spark):
        linked = _links(spark, d, sets, classes)
        linked = lasting(linked, "linked")
    # Names of components: the least id of all their classes.
    named = classes.select("s1", "s2", "least").join(linked.withColumnRenamed("node", "s1"), "s1", "left")
    of_linked = named.where("component is not null").groupBy("component").agg(F.min("least").alias("least_all"))
    named = named.join(of_linked, "component", "left").select("s1", "s2", F.coalesce("least_all", "least").alias("component_id"), F.coalesce("component", "s1").alias("group_key"))
    out = sets.join(named, ["s1", "s2"], "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("group_key")).alias("group_key"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("th", "group_key")
