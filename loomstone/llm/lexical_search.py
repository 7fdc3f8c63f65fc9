"""Ranked lexical search: MaxScore over shards of documents.

A first pass counts in every whole text the terms that a query has (the query set is
stated; its terms are broadcast, in blocks of about ``MOST_PAIRS`` pairs of query and
term) and stages a short row per document.  Sizes and document frequencies come from
those rows.  Then each task inverts its rows shard by shard (``SHARD_POSTINGS``) and
ranks every query in it: terms are sorted by the most that they add to a score in
this shard; the longest run of weak terms that together stay below the score of the
worst of the best ``k`` so far is non-essential.  Documents come from the postings of
the other, essential terms; those of non-essential terms are only looked up, strongest
first, for documents that can still qualify.  The bar rises from shard to shard of a
task; each task gives ``k`` rows a query at most, and the best of these are the result.

Defined results: a null text and a text without terms are no documents; a query
without terms has no rows; queries of one id are one query with all their terms;
every row is a document, repeated ids too; a null id comes last among equal scores;
empty tables give no rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, documents, lasting, ship, staged, temporary, text_bytes

K = 50
#: Pairs of query and term that a block holds, and postings and documents that are ranked at once.
MOST_PAIRS, SHARD_POSTINGS, STEP = 100_000, 1 << 21, 8192
#: Fixed: letters, digits and all beyond ASCII are terms; of letters only A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HIT = "item_id long, score long, doc_id long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each query."""

    def run(batches):
        for b in chunks(batches):
            ids, terms = [], []
            for i, t in zip(b.column("item_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                own = list(dict.fromkeys(terms_of(t)))
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    ship(items.sparkSession)
    d = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.mapInArrow(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (its terms with repeats), and the terms of the vocabulary that it has, as numbers, with how often."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for b in chunks(batches):
            ids, sizes, ends, terms, counts = [], [], [0], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                if not (words := terms_of(t)):
                    continue
                tf = Counter(words)
                own = tf.keys() & known.keys()
                terms += map(known.__getitem__, own)
                counts += map(tf.__getitem__, own)
                ids.append(d)
                sizes.append(len(words))
                ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The ``k`` best of a query so far: scores falling, then ids rising, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """The least score that can still enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def take(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        s, u, d = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.doc, doc])
        order = np.lexsort((d, u, -s))[: self.k]
        self.score, self.null, self.doc = s[order], u[order], d[order]


class Shard:
    """The postings of some documents: for each term the documents that have it, rising, what it adds to their scores, and the most of that."""

    def __init__(self, null: np.ndarray, doc: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        self.null, self.doc = null, doc
        at = np.repeat(np.arange(len(doc)), sizes)
        gain = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
        use = np.flatnonzero(gain > 0)
        use = use[np.argsort(terms[use], kind="stable")]
        self.at, self.gain = at[use], gain[use]
        found, starts = np.unique(terms[use], return_index=True)
        ends = np.append(starts[1:], len(use))
        tops = np.maximum.reduceat(self.gain, starts) if len(use) else []
        self.lists = {int(t): (int(i), int(j), int(top)) for t, i, j, top in zip(found, starts, ends, tops, strict=True)}

    def rank(self, terms: list[int], best: Best) -> None:
        """Takes the documents of this shard that belong to the best of a query."""
        own = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: x[2])
        if not own:
            return
        docs, gains = [self.at[i:j] for i, j, _ in own], [self.gain[i:j] for i, j, _ in own]
        most = np.cumsum([top for *_, top in own])  # of the weakest terms together
        for base in range(0, len(self.doc), STEP):
            bar = best.bar
            essential = int(np.searchsorted(most, bar, side="left"))
            if essential == len(own):
                return  # all terms together stay below the bar
            score = np.zeros(min(STEP, len(self.doc) - base), np.int64)
            for k in range(essential, len(own)):
                i, j = np.searchsorted(docs[k], (base, base + STEP))
                score[docs[k][i:j] - base] += gains[k][i:j]
            at = np.flatnonzero(score)
            for k in range(essential - 1, -1, -1):
                at = at[score[at] + most[k] >= bar]
                if not len(at):
                    break
                place = np.searchsorted(docs[k], at + base)
                place[place == len(docs[k])] = 0
                hit = docs[k][place] == at + base
                score[at[hit]] += gains[k][place[hit]]
            at = at[score[at] >= bar]
            if len(at):
                best.take(score[at], self.null[base + at], self.doc[base + at])


def _shards(batches):
    """Tables of about ``SHARD_POSTINGS`` postings."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column("terms").flatten())
        if n >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists of a column, and all their values."""
    a = column.combine_chunks()
    return np.diff(np.asarray(a.offsets)), np.asarray(a.flatten(), dtype=np.int64)


def ranked_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, score, doc_id: the ``k`` best of each query of a block (id, terms), from every task."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, own in items for t in own}))}
    with temporary(spark, large=False):
        found = lasting(postings(docs, vocabulary, id_col, text_col), "postings")
        shape = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all")).first()
        df = staged(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df").toPandas()
    n, total = shape.n, shape.all or 1
    weights = np.zeros(len(vocabulary) or 1, np.int64)
    weights[df["term"].to_numpy(dtype=np.int64)] = np.floor(1000 * np.log((2 * n + 2) / (2 * df["df"].to_numpy(dtype=np.int64) + 1))).astype(np.int64)
    shared = spark.sparkContext.broadcast((weights, [(i, sorted(map(vocabulary.__getitem__, own))) for i, own in items]))

    def run(batches):
        weights, asked = shared.value
        best = [Best(k) for _ in asked]
        for table in _shards(batches):
            ids = table.column("doc_id").combine_chunks()
            table = table.take(np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))))
            ids = table.column("doc_id").combine_chunks()
            sizes, terms = _flat(table.column("terms"))
            m = 100 - 50 + (50 * np.asarray(table.column("n"), dtype=np.int64) * n) // total
            shard = Shard(np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)), m, sizes, terms, _flat(table.column("tfs"))[1], weights)
            for (_, own), b in zip(asked, best, strict=True):
                shard.rank(own, b)
        for (item, _), b in zip(asked, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), pa.int64()), pa.array(b.score), pa.array(b.doc, mask=b.null)], names=["item_id", "score", "doc_id"])

    return found.mapInArrow(run, HIT)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query, of all documents."""
    spark = docs.sparkSession
    with temporary(spark, large=False):
        pairs = staged(query_terms(items, item_col, item_text), "terms")
        blocks = max(1, -(-pairs.count() // MOST_PAIRS))
        found = []
        for b in range(blocks):  # of the query set; one pass over the documents each
            own: dict = {}
            for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
                own.setdefault(r.item_id, []).append(bytes(r.term))
            if own:
                found.append((list(own.items())))
        hits = [lasting(ranked_block(docs, own, k, id_col, text_col), "hits") for own in found]
    all_ = reduce(DataFrame.union, hits) if hits else spark.createDataFrame([], HIT)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return all_.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
t AS (SELECT r, doc_id, unnest(ts) AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT r, len(ts) AS n FROM d WHERE len(ts) > 0),
sh AS (SELECT count(*) AS nd, sum(n)::BIGINT AS total FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM df, sh),
m AS (SELECT r, 100 - 50 + ((50 * n * nd) // total) AS m FROM dl, sh),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s QUALIFY rank <= {K}
"""
