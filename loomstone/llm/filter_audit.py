"""Filter interaction audit: what each of five filters removes, keeps from others or does twice, under every order.

Rows are routed by the xxhash of their text over an RDD.  A partition holds chains
(for each hash the full texts that have it, each with its least id); a row whose
text is there under a smaller id is emitted as failing.  Chains are kept on both
sides of the shuffle: before it over ``HELD_BYTES`` of text at a time, so that of a
text that a third of all rows hold each task sends one row, and after it over a
partition of about ``ROUTED_BYTES`` of distinct texts.  A document then is five bits
(which filters it fails), and ``combineByKey`` adds vectors of counts by these 32
masks; every figure of every order follows from a part's vector.

Defined results: a null text is empty, a null part is the empty string; a row with a
null id neither fails E nor makes others fail, and has no label; rows of one id and
text do not make each other fail; of several labels of an id the highest holds; an
empty table gives no rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, documents, ship

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
MASKS = 1 << len(FILTERS)
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Text that a task holds before it sends on, and distinct text of a partition after.
HELD_BYTES, ROUTED_BYTES = 8 << 20, 16 << 20
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes, n_chars: int) -> int:
    """The bits of the conditions A to D that a text meets."""
    words = text.split()  # at exactly the six characters that separate words
    bits = A if len(words) < 100 else 0
    if 100 * len(set(words)) < 80 * len(words):
        bits |= B
    if 100 * (len(text) - len(text.translate(None, UPPER))) > 10 * n_chars:
        bits |= C
    if len(text) != len(text.translate(None, MARKS)):
        bits |= D
    return bits


class Chains:
    """Texts by hash, each with its least id and the rows of that id (how many of each part)."""

    def __init__(self):
        self.by_hash: dict[int, list[list]] = {}
        self.held = 0

    def add(self, h: int, text: bytes, doc_id: int, bits: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes in rows; yields (id, bits, parts) of those that now are known to fail E."""
        chain = self.by_hash.setdefault(h, [])
        for entry in chain:
            if entry[0] == text:
                least = entry[1]
                if doc_id == least:
                    for p, n in parts.items():
                        entry[3][p] = entry[3].get(p, 0) + n
                elif doc_id > least:
                    yield doc_id, bits | E, parts
                else:
                    yield least, bits | E, entry[3]
                    entry[1], entry[3] = doc_id, dict(parts)
                return
        chain.append([text, doc_id, bits, dict(parts)])
        self.held += len(text)

    def empty(self) -> Iterator[tuple]:
        """(hash, text, id, bits, parts) of what is left, which then is forgotten."""
        for h, chain in self.by_hash.items():
            for text, doc_id, bits, parts in chain:
                yield h, text, doc_id, bits, parts
        self.by_hash, self.held = {}, 0


def _settled(doc_id: int | None, bits: int, parts: dict[str, int]) -> tuple:
    """A row that needs no other: it travels without its text, dealt out by its id."""
    return xxhash.xxh64_intdigest(str(doc_id)), (None, doc_id, bits, parts)


def _route(rows: Iterable) -> Iterator[tuple]:
    """(hash, (text or None where settled, id, bits, parts)) of a task's rows."""
    chains = Chains()
    unknown: dict[tuple, int] = {}  # rows without an id, by bits and part
    for doc_id, part, text in rows:
        data = (text or "").encode()
        bits = failures(data, len(text or ""))
        if doc_id is None:
            unknown[bits, part] = unknown.get((bits, part), 0) + 1
            continue
        for lost in chains.add(xxhash.xxh64_intdigest(data), data, doc_id, bits, {part: 1}):
            yield _settled(*lost)
        if chains.held > HELD_BYTES:
            yield from ((h, rest) for h, *rest in chains.empty())
    yield from ((h, rest) for h, *rest in chains.empty())
    for (bits, part), n in unknown.items():
        yield _settled(None, bits, {part: n})


def _chained(rows: Iterable) -> Iterator[tuple]:
    """(id, part, bits, n) of all rows that were routed to one partition."""
    chains = Chains()
    for h, (text, doc_id, bits, parts) in rows:
        lost = [(doc_id, bits, parts)] if text is None else chains.add(h, text, doc_id, bits, parts)
        for i, b, own in lost:
            yield from ((i, p, b, n) for p, n in own.items())
    for _, _, doc_id, bits, parts in chains.empty():
        yield from ((doc_id, p, bits, n) for p, n in parts.items())


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, bits (of the filters that it fails) and n, the number of such rows: one row per document, rows of one id and text together."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(f"`{text_col}`").cast("string")
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("p"), text.alias("t"))
    routed = slim.rdd.mapPartitions(_route).partitionBy(buckets_for(spark, total, ROUTED_BYTES), int)
    return spark.createDataFrame(routed.mapPartitions(_chained), "doc_id long, part string, bits int, n long", verifySchema=False)


def _add(vector: list[int], row) -> list[int]:
    """Counts of documents, good ones and toxic ones by mask."""
    vector[row.bits] += row.n
    vector[MASKS + row.bits] += row.n * row.good
    vector[2 * MASKS + row.bits] += row.n * row.toxic
    return vector


def _merge(one: list[int], other: list[int]) -> list[int]:
    return [x + y for x, y in zip(one, other, strict=True)]


def figures(n: list[int]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique fails, good lost, toxic lost, shapley) from a part's vector, for all orders."""
    good, toxic, out, shapley = n[MASKS : 2 * MASKS], n[2 * MASKS :], [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails = [m for m in range(MASKS) if m & bit]
            here = [m for m in fails if not m & before]
            removed = sum(n[m] for m in here)
            shapley[letter] += removed
            kept = sum(n[m] for m in range(MASKS) if not m & (before | bit))
            out.append(("".join(order), step, kept, removed, sum(n[m] for m in fails) - removed, n[bit], sum(good[m] for m in here), sum(toxic[m] for m in here), letter))
            before |= bit
    return ((*row, shapley[letter]) for *row, letter in out)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and the figures of that step, for each part and all 120 orders."""
    spark = docs.sparkSession
    m = masks(docs, id_col, text_col, part_col)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = m.join(told, m.doc_id == told.d, "left").select("part", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by_part = marked.rdd.map(lambda r: (r.part, r)).combineByKey(lambda r: _add([0] * (3 * MASKS), r), _add, _merge)
    return spark.createDataFrame(by_part.flatMap(lambda x: ((x[0], *row) for row in figures(x[1]))), SCHEMA, verifySchema=False)


def query(spark, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
v AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM w),
f AS (SELECT doc_id, part, [CASE WHEN len(words) < 100 THEN 1 ELSE 0 END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 1 ELSE 0 END,
  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 1 ELSE 0 END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END,
  CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 1 ELSE 0 END] AS fails FROM v),
l AS (SELECT doc_id AS d, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON d = doc_id GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(ks, lambda k: 'ABCDE'[k]), '') AS filter_order, x.k AS step, ks[x.k] AS own, ks[1:x.k - 1] AS earlier FROM o, x),
r AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] = 1 AS bad, list_sum(fails) AS all_fails, coalesce(list_sum(list_transform(earlier, lambda k: fails[k])), 0) > 0 AS gone FROM n, s),
g AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND all_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
