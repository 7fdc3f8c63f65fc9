"""Enrichment of documents: personal data out first, then language, dates of validity and keywords of what is left."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, language
from . import pii
from .graph import cut

#: Fixed: words before the dates of validity; how many keywords a document has.
FROM = r"(?i)(?:effective(?:\s+from)?|valid\s+from)\s*[:\-]?\s*"
UNTIL = r"(?i)(?:valid\s+until|expires(?:\s+on)?|until)\s*[:\-]?\s*"
DAY, LONG_DAY = r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2}\s+\w+\s+\d{4})"
KEYWORDS, MOST_KEYWORDS = 10, 12


def _date(text: Column, before: str) -> Column:
    """The first date after some words, in figures or with the month's name."""
    plain = F.try_to_date(F.regexp_extract(text, before + DAY, 1), "yyyy-MM-dd")
    return F.coalesce(plain, F.try_to_date(F.regexp_extract(text, before + LONG_DAY, 1), "d MMMM yyyy"))


def effective_dates(text: Column) -> tuple[Column, Column]:
    """From when to when a text says that it holds; an end that is not after its start is none."""
    start, end = _date(text, FROM), _date(text, UNTIL)
    return start, F.when(start.isNull() | (end > start), end)


def _frequent(k: int):
    """The ``k`` most frequent words of each row, the first found first on a tie: a counter has them in that order."""

    def run(batches):
        for b in batches:
            found = []
            for words in b.column("words").to_pylist():
                own = Counter((words or "").split())
                for w in STOP_WORDS:
                    own.pop(w, None)
                found.append(own.most_common(k))
            flat = [x for own in found for x in own]
            at = [k for k, own in enumerate(found) for _ in own]
            places = [n for own in found for n in range(1, len(own) + 1)]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array([w for w, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int64()), pa.array(places, pa.int32())], names=["id", "word", "n", "place"])

    return run


def keyword_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = KEYWORDS) -> DataFrame:
    """(id, word, n, place): the ``k`` most frequent words of each document that are no stop words, ties by first place.

    Words are counted where the text is and nothing is shuffled; only the words of rows
    that have an id in common are brought together.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))
    schema = f"id {dict(d.dtypes)['id']}, word string, n long, place int"
    alone = lambda rows: rows.select("id", F.array_join(words, " ").alias("words")).mapInArrow(_frequent(k), schema)
    twice = cut(d.groupBy("id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col("id").alias("_twice")))
    if not twice.limit(1).count():
        return alone(d)
    same = F.col("id").eqNullSafe(F.col("_twice"))
    each = d.join(twice, same, "left_semi").select("id", F.posexplode(words).alias("pos", "word")).where(~F.col("word").isin(*STOP_WORDS))
    g = each.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))).where(F.col("place") <= k)
    return alone(d.join(twice, same, "left_anti")).union(g.select("id", "word", "n", "place"))


def clean_keywords(raw: Column, most: int = MOST_KEYWORDS) -> Column:
    """Lower case, single spaces, no marks at the ends, none twice, ``most`` of them."""
    clean = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r"^[ .,;:!?]+|[ .,;:!?]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), 1, most)


def enrich(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "mask") -> DataFrame:
    """(id, text, pii_types, lang, effective_from, effective_to, keywords) of documents with ids of their own.

    All that follows sees the redacted text.  Equal texts are worked on once.  A null
    text is an empty one.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")).withColumn("h", F.sha2("raw", 256))
    one = d.groupBy("h").agg(F.min("id").alias("own"), F.first("raw").alias("raw"))
    clean = cut(pii.scan(one, "own", "raw", mode).select(F.col("id").alias("own"), F.col("redacted").alias("text"), F.col("kinds").alias("pii_types")))
    words = keyword_counts(clean, "own").groupBy(F.col("id").alias("own")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"))
    start, end = effective_dates(F.col("text"))
    none = F.array().cast("array<string>")
    rich = clean.join(words, "own", "left").select("own", "text", "pii_types", language("text").alias("lang"), start.alias("effective_from"), end.alias("effective_to"), clean_keywords(F.coalesce("words", none)).alias("keywords"))
    return d.select("id", "h").join(one.select("h", "own"), "h").join(rich, "own").select("id", "text", "pii_types", "lang", "effective_from", "effective_to", "keywords")
