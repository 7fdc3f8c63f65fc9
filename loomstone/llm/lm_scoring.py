"""Scores of texts under a hashed maximum-entropy model of words.

Method: words are the leaves of a tree of least mean depth for their counts, with
``FAN`` branches at a node; the probability of a word is the product of those of the
branches down to it, each a softmax over weights of hashed features: the word before,
the two words before together, and the word before the last (a skip).  All known
words are leaves; those past them share a leaf, in which they have their smoothed
unigram shares, and are told apart as features.  Tables of weights grow with the
root of the number of words.  Training is ``ROUNDS`` rounds of distributed gradient
updates, each over its own part of the texts: the shards of a round start from the
merged weights of the one before, take mini-batch steps scaled by how often a row of
weights was used, and are merged row by row, by use.  Shards and the order in them
follow from hashes of the texts, so a model does not depend on files or tasks; their
number grows with the text.  Scoring takes sparse batches of numpy arrays.

Words are known by 64-bit hashes.  Counts cover all training documents and stay in
a table; the ``KNOWN`` most frequent go to all workers, the rest are joined.

Defined results: null is the empty text, a single end; with nothing to train on
every word is unseen; ids of null train; repeated rows count and are scored each; an
empty table gives no rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, chunks, documents, mixed, rows, staged, sweep, text_bytes
from .runs import Rolling

#: Words that go to all workers, branches of a node.
KNOWN, FAN = 1 << 18, 16
#: The least rows of weights for the root and for other nodes.
ROOT_ROWS, NODE_ROWS = 1 << 15, 1 << 17
#: Rounds of updates; the least text of a shard, in bytes and in sizes of the model, which each shard sends.
ROUNDS, SHARD_BYTES, SHARD_MODELS = 2, 16 << 20, 1
RATE, BATCH, BLOCK, FEW = 0.4, 8192, 4096, 4
#: Bytes of text that are taken at once.
TEXT_BYTES = 1 << 20
TOP = 1 << 63
#: The end of a text as a word; bytes as numbers; which bytes separate words.
END = int(mixed(np.array([10], dtype=np.uint64), 50)[0]) | TOP
SLOT_BITS = 20
_VALUES = mixed(np.arange(256, dtype=np.uint64), 51)
_GAP = np.isin(np.arange(256), list(SPACES))
LOG10 = float(np.log(10))


class Codes:
    """Numbers of the known words; other words have their hash, which has the high bit set.

    Words are found and hashed a buffer at a time; a word's number is looked up in a
    table of slots by the high bits of its hash.
    """

    def __init__(self, known: np.ndarray | None = None):
        known = np.zeros(0, dtype=np.uint64) if known is None else known
        slot = self._slot(known)
        by = np.argsort(slot, kind="stable")
        self.hashes, self.numbers = known[by], by.astype(np.uint64)
        self.start = np.searchsorted(slot[by], np.arange((1 << SLOT_BITS) + 1))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h << np.uint64(1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def numbered(self, h: np.ndarray) -> np.ndarray:
        out, slot = h.copy(), self._slot(h)
        at, stop = self.start[slot], self.start[slot + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            same = self.hashes[here] == h[left]
            out[left[same]] = self.numbers[here[same]]
            left = left[~same & (here + 1 < stop[left])]
            at[left] += 1
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts' tokens in turn, an end after each text, and how many each has."""
        text = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), dtype=np.uint8)
        gap = _GAP[text]
        begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        h = Rolling(_VALUES[text]).stretches(begin, end) | np.uint64(TOP)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        n = np.diff(np.searchsorted(begin, np.append(0, np.cumsum(size))))
        out = np.empty(len(h) + len(texts), dtype=np.uint64)
        inner = np.ones(len(out), dtype=bool)
        inner[np.cumsum(n + 1) - 1] = False
        out[inner], out[~inner] = h, END
        return self.numbered(out), n + 1


def _count(batches):
    held, size = [], 0
    codes = Codes()

    def flush():
        h, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(n, weights=np.concatenate([y for _, y in held])).astype(np.int64)

    for b in chunks(batches, most=TEXT_BYTES):
        own, _ = codes.of(text_bytes(b.column("text")))
        h, n = np.unique(own, return_counts=True)
        held.append((h, n))
        size += len(h)
        if size > 2_000_000:
            held = [flush()]
            size = len(held[0][0])
            if size > 1_000_000:
                yield _counted(*held[0])
                held, size = [], 0
    if held:
        yield _counted(*flush())


def _counted(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent and branch of every leaf and node, and the weight of each; leaves come first, the root last."""
    heap = [(w, k) for k, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    parent, branch, total = [0] * len(heap), [0] * len(heap), weights.tolist()
    take = (len(heap) - 2) % (FAN - 1) + 2 if len(heap) > 1 else 1
    while True:
        own = [heapq.heappop(heap) for _ in range(take)]
        node = len(total)
        for k, (_, child) in enumerate(own):
            parent[child], branch[child] = node, k
        parent.append(0)
        branch.append(0)
        total.append(sum(w for w, _ in own))
        if not heap:
            return np.array(parent), np.array(branch), np.array(total)
        heapq.heappush(heap, (total[-1], node))
        take = FAN


class Vocabulary:
    """The known words by falling count, the tree over them, and totals of all training tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, kinds: int):
        self.hashes, self.counts, self.tokens, self.kinds = hashes, counts, tokens, kinds
        k = self.words = len(counts)
        self.rare_total = tokens - int(counts.sum()) + 0.5 * (kinds - k + 1)
        parent, branch, total = _tree(np.append(counts + 0.5, self.rare_total))
        root = len(total) - 1
        bias = np.full((root - k, FAN), -1e9, dtype=np.float32)
        bias[parent[:-1] - k - 1, branch[:-1]] = np.log(total[:-1])
        bias -= bias.max(axis=1, keepdims=True)
        self.root_bias, self.node_bias = bias[-1], bias
        # Each leaf's branch at the root, and its nodes below that with the branch at each.
        leaf = at = np.arange(k + 1)
        self.top, steps = np.zeros(k + 1, dtype=np.int64), []
        while len(leaf):
            up = parent[at]
            high = up == root
            self.top[leaf[high]] = branch[at[high]]
            leaf, at, up = leaf[~high], at[~high], up[~high]
            steps.append((leaf, up - k - 1, branch[at]))
            at = up
        leaf, node, own = (np.concatenate([x[c] for x in steps]) for c in range(3))
        by = np.argsort(leaf, kind="stable")
        self.path_node, self.path_branch = node[by].astype(np.int32), own[by].astype(np.int8)
        self.depth = np.bincount(leaf, minlength=k + 1)
        self.path_start = np.cumsum(self.depth) - self.depth
        # Powers of two.
        grown = 1 << max(0, int(kinds**0.5) - 1).bit_length()
        self.root_rows, self.node_rows = max(ROOT_ROWS, 32 * grown), max(NODE_ROWS, 128 * grown)

    def codes(self) -> Codes:
        return Codes(self.hashes.view(np.uint64))

    def features(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every token (``words`` for all that are not known) and its three feature hashes, of the words themselves."""
        leaf = np.where(codes < self.words, codes, self.words).astype(np.int64)
        start = np.cumsum(n) - n
        before = np.uint64((1 << 64) - 1)
        back = np.full(len(codes) + 2, before, dtype=np.uint64)
        back[2:] = codes
        one, two = back[1:-1].copy(), back[:-2].copy()
        one[start] = before
        two[start] = before
        two[np.minimum(start + 1, len(codes) - 1)] = before
        one, skip = mixed(one, 1), mixed(two, 2)
        with np.errstate(over="ignore"):
            return leaf, np.stack([one, mixed(one + skip * np.uint64(0xD6E8FEB86659FD93), 3), skip], axis=1)

    def below(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps of all tokens under the root: number of the token, node, branch."""
        n = self.depth[leaf]
        token = np.repeat(np.arange(len(leaf)), n)
        at = np.arange(len(token)) + np.repeat(self.path_start[leaf] - (np.cumsum(n) - n), n)
        return token, self.path_node[at], self.path_branch[at]


class Weights:
    """``c`` for the root, ``m`` for all other nodes."""

    def __init__(self, v: Vocabulary, parts: dict[str, np.ndarray] | None = None):
        self.v = v
        self.c = parts["c"] if parts else np.zeros((v.root_rows, FAN), dtype=np.float32)
        self.m = parts["m"] if parts else np.zeros((v.node_rows, FAN), dtype=np.float32)

    def _root_rows(self, f: np.ndarray) -> np.ndarray:
        return (f & np.uint64(self.v.root_rows - 1)).astype(np.int64)

    def _node_rows(self, f: np.ndarray, node: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (f + (node[:, None].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(65 - self.v.node_rows.bit_length())).astype(np.int64)

    @staticmethod
    def _logits(w: np.ndarray, at: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """The sum of the rows that each token has, and the bias, within what an exponential can hold."""
        z = w.take(at[:, 0], axis=0)
        z += w.take(at[:, 1], axis=0)
        z += w.take(at[:, 2], axis=0)
        z += bias
        return np.clip(z, -80, 80, out=z)

    def _log_probs(self, w: np.ndarray, at: np.ndarray, bias: np.ndarray, branch: np.ndarray) -> np.ndarray:
        z = self._logits(w, at, bias)
        own = z[np.arange(len(z)), branch].astype(np.float64)
        return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], dtype=np.float32))

    def log_probs(self, leaf: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's leaf."""
        out = np.empty(len(leaf), dtype=np.float64)
        for i in range(0, len(leaf), BATCH):
            w, g = leaf[i : i + BATCH], f[i : i + BATCH]
            lp = self._log_probs(self.c, self._root_rows(g), self.v.root_bias, self.v.top[w])
            token, node, branch = self.v.below(w)
            if len(token):
                own = self._log_probs(self.m, self._node_rows(g[token], node), self.v.node_bias.take(node, axis=0), branch)
                lp += np.bincount(token, weights=own, minlength=len(w))
            out[i : i + BATCH] = lp
        return out

    def train(self, stream, used: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Gradient steps over (leaf, features) arrays; adds to and returns how often each row was used."""
        used = used or (np.zeros(len(self.c), dtype=np.int64), np.zeros(len(self.m), dtype=np.int64))
        for leaf, f in stream:
            for i in range(0, len(leaf), BATCH):
                w, g = leaf[i : i + BATCH], f[i : i + BATCH]
                self._step(self.c, self._root_rows(g), self.v.root_bias, self.v.top[w], used[0])
                token, node, branch = self.v.below(w)
                if len(token):
                    self._step(self.m, self._node_rows(g[token], node), self.v.node_bias.take(node, axis=0), branch, used[1])
        return used

    def _step(self, w: np.ndarray, at: np.ndarray, bias: np.ndarray, target: np.ndarray, used: np.ndarray) -> None:
        g = self._logits(w, at, bias)
        np.exp(g, out=g)
        g *= (1 / (g @ np.ones(g.shape[1], dtype=np.float32)))[:, None]
        g[np.arange(len(g)), target] -= 1
        flat = at.ravel()
        # By 16 bits at a time, for that sorts without comparing.
        by = np.argsort(flat.astype(np.uint16), kind="stable")
        if len(w) > 1 << 16:
            by = by[np.argsort((flat[by] >> 16).astype(np.uint16), kind="stable")]
        own = flat[by]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        n = np.diff(np.append(first, len(own)))
        row, by = own[first], by // 3
        # Rows with few uses are summed use by use, the others as segments, which cost by their number.
        total = g.take(by[first], axis=0)
        for k in range(1, FEW):
            at = np.flatnonzero((n > k) & (n <= FEW))
            total[at] += g.take(by[first[at] + k], axis=0)
        if len(at := np.flatnonzero(n > FEW)):
            total[at] = np.add.reduceat(g.take(by[np.repeat(n > FEW, n)], axis=0), np.cumsum(n[at]) - n[at], axis=0)
        used[row] += n
        w[row] -= (RATE / np.sqrt(used[row]))[:, None].astype(np.float32) * total


UPDATES = "part string, block int, shard int, w binary, n binary"


def _training(shared):
    """A shard's weights after its steps, block by block and in half precision, and how often each row was used."""

    def run(batches):
        v, parts, before = shared.value
        codes, now, w, used = v.codes(), None, None, ()

        def updates():
            for name, table, count in (("c", w.c, used[0]), ("m", w.m, used[1])):
                own = count - before[name]
                for k in range(0, len(table), BLOCK):
                    if (n := own[k : k + BLOCK].astype(np.float32)).any():
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([now], pa.int32()), pa.array([table[k : k + BLOCK].astype(np.float16).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=[x.split()[0] for x in UPDATES.split(", ")])

        for b in chunks(batches, most=TEXT_BYTES):
            shard = np.asarray(b.column("shard"))
            edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(edge, edge[1:], strict=False):
                if shard[i] != now:
                    if now is not None:
                        yield from updates()
                    now, w = int(shard[i]), Weights(v, {k: x.copy() for k, x in parts.items()})
                    used = tuple(before[k].astype(np.int64) for k in ("c", "m"))
                w.train([v.features(*codes.of(text_bytes(b.column("text").slice(i, j - i))))], used)
        if now is not None:
            yield from updates()

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The mean of the shards' rows of a block, by use; in the order of shards, for sums depend on it."""
    table = table.sort_by("shard")
    w, n = 0.0, 0.0
    for x, y in zip(table.column("w").to_pylist(), table.column("n").to_pylist(), strict=True):
        uses = np.frombuffer(y, dtype=np.float32).astype(np.float64)
        w, n = w + np.frombuffer(x, dtype=np.float16).reshape(len(uses), -1) * uses[:, None], n + uses
    w /= np.maximum(n, 1)[:, None]
    return pa.table({"part": table.column("part")[:1], "block": table.column("block")[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n.astype(np.float32).tobytes()], pa.binary())})


def fit(training: DataFrame) -> tuple[DataFrame, Weights]:
    """The table of counts (h, n) of all training tokens and the model; ``training`` has a column text.

    Shards and their order follow from the texts, not from how the table is stored.
    """
    spark = training.sparkSession
    counts = staged(training.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    kinds, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
    hashes, number = np.asarray(top.column("h"), dtype=np.int64), np.asarray(top.column("n"), dtype=np.int64)
    by = np.lexsort((hashes, -number))
    v = Vocabulary(hashes[by], number[by], int(tokens), int(kinds))
    parts = {"c": np.zeros((v.root_rows, FAN), dtype=np.float32), "m": np.zeros((v.node_rows, FAN), dtype=np.float32)}
    used = {k: np.zeros(len(x), dtype=np.int32) for k, x in parts.items()}
    own = training.select("text", F.xxhash64("text", F.lit(6)).alias("h"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -int(-size / ROUNDS // max(SHARD_BYTES, SHARD_MODELS * sum(x.nbytes for x in parts.values()))))
    shard = F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int")
    for k in range(ROUNDS):
        dealt = own.where(F.pmod("h", F.lit(ROUNDS)) == k).select(shard.alias("shard"), "h", "text").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h")
        each = dealt.mapInArrow(_training(spark.sparkContext.broadcast((v, parts, used))), UPDATES)
        parts, used = {k: x.copy() for k, x in parts.items()}, {k: x.copy() for k, x in used.items()}
        for r in each.groupBy("part", "block").applyInArrow(_merge, "part string, block int, w binary, n binary").collect():  # as large as the model
            w, n = np.frombuffer(r.w, dtype=np.float32), np.frombuffer(r.n, dtype=np.float32)
            rows_ = np.flatnonzero(n)
            parts[r.part][r.block + rows_] = w.reshape(len(n), -1)[rows_]
            used[r.part][r.block + rows_] += np.ceil(n[rows_] / shards).astype(np.int32)
        del dealt, each
        sweep(spark)
    return counts, Weights(v, parts)


def _scoring(shared):
    def run(batches):
        model = shared.value
        v = model.v
        codes = v.codes()
        log = np.log10(v.counts + 0.5)
        for b in chunks(batches, most=TEXT_BYTES):
            own, n = codes.of(text_bytes(b.column("text")))
            doc = np.repeat(np.arange(len(n)), n)
            leaf, f = v.features(own, n)
            lp = model.log_probs(leaf, f) / LOG10
            known = own < len(log)
            smooth = np.zeros(len(own))
            smooth[known] = log[own[known].astype(np.int64)]
            total = lambda x: np.bincount(doc, weights=x, minlength=len(n))
            rest = np.flatnonzero(~known)
            edge = np.searchsorted(doc[rest], np.arange(len(n) + 1))
            unseen = own[rest].view(np.int64)
            lists = [unseen[i:j].tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n), pa.array(total(known).astype(np.int64)), pa.array(total(smooth)), pa.array(total(lp - np.where(known, 0, np.log10(v.rare_total)))), pa.array(lists, pa.binary())],
                names=["doc_id", "th", "n_tokens", "known", "smooth", "score", "rest"],
            )

    return run


def _rest(batches):
    """A row for each document and word outside the known ones, with its number there."""
    for b in batches:
        lists = b.column("rest").to_pylist()
        n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 8
        h, doc = np.frombuffer(b"".join(lists), dtype=np.int64), np.repeat(np.arange(len(n)), n)
        by = np.lexsort((h, doc))
        h, doc = h[by], doc[by]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
        at = pa.array(doc[first])
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), pa.array(h[first]), pa.array(np.diff(np.append(first, len(h))))], names=["d2", "th2", "h", "times"])


def lm_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, th, n_tokens, n_known, train_tokens, base_score, score."""
    d = rows(docs, id_col, text_col)
    counts, model = fit(training)
    v = model.v
    scored = staged(d.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, th long, n_tokens long, known long, smooth double, score double, rest binary"), "scored")
    # Rows that the input repeats are one here, so that each gets its own words once.
    rest = scored.where(F.length("rest") > 0).select("doc_id", "th", "rest").dropDuplicates(["doc_id", "th"]).mapInArrow(_rest, "d2 long, th2 long, h long, times long")
    c = F.coalesce("n", F.lit(0))
    more = rest.join(counts, "h", "left").groupBy("d2", "th2").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_smooth"), F.sum("times").alias("more"))
    out = scored.drop("rest").join(more, scored.doc_id.eqNullSafe(F.col("d2")) & (scored.th == F.col("th2")), "left")
    some = lambda x: F.coalesce(x, F.lit(0))
    return out.select(
        "doc_id", "th", "n_tokens",
        (F.col("known") + some("more_known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("smooth") + some("more_smooth") - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + 0.5 * (v.kinds + 1))))).alias("base_score"),
        (F.col("score") + some("more_smooth")).alias("score"),
    )


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = lm_scores(docs, docs.where(~held_out()).select("text"))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
