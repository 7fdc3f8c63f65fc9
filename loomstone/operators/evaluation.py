"""Evaluation of items: metrics, aggregates, gates, comparisons and reports.

An item is a row with a key, metrics (null where unmeasured) and whether it passed.
Scores of single answers are columns; what needs several rows takes and gives tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import cosine


@dataclass(frozen=True)
class Limit:
    """A metric's least value, or its greatest; a hard one is never below 1."""

    metric: str
    value: float
    hard: bool = False
    upper: bool = False

    @property
    def bound(self) -> float:
        return max(self.value, 1.0) if self.hard else self.value

    def fails(self, value: Column) -> Column:
        return value > self.bound if self.upper else value < self.bound


# --- aggregates -------------------------------------------------------------------------


def aggregate(items: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), passed: str = "passed", cost: str = "cost", digits: int = 6) -> DataFrame:
    """Means of metrics over what is measured, pass_rate, n and cost, of all items or of each group."""
    means = [F.round(F.avg(m), digits).alias(m) for m in metrics]
    return items.groupBy(*by).agg(*means, F.round(F.avg(F.col(passed).cast("double")), digits).alias("pass_rate"), F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), digits).alias("cost"))


def rollup(items: DataFrame, *by: str) -> DataFrame:
    """Counts of all combinations, with subtotals."""
    return items.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def failing(items: DataFrame, by: str, passed: str = "passed") -> DataFrame:
    """Failed items of each group."""
    return items.where(~F.col(passed)).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def worst(items: DataFrame, metrics: Sequence[str], k: int, key: str = "item_id", passed: str = "passed") -> DataFrame:
    """The ``k`` worst: failing first, then the lowest sum of metrics, where an unmeasured one counts as 0."""
    total = reduce(lambda a, b: a + b, (F.coalesce(m, F.lit(0.0)) for m in metrics))
    return items.orderBy(passed, total, key).limit(k)


def chosen(items: DataFrame, column: str, values: Sequence, k: int, key: str = "item_id") -> DataFrame:
    """The first ``k`` items with one of some values."""
    return items.where(F.col(column).isin(*values)).orderBy(key).limit(k)


# --- gates ------------------------------------------------------------------------------


def limits(spark: SparkSession, rules: Sequence[Limit]) -> DataFrame:
    return spark.createDataFrame([(r.metric, r.bound, r.hard, r.upper) for r in rules], "metric string, floor double, hard boolean, upper boolean")


def _beyond(rules: Sequence[Limit], value: str) -> Column:
    """Whether the value of a row's metric breaks its limit."""
    out = F.lit(None).cast("boolean")
    for r in rules:
        out = F.when(F.col("metric") == r.metric, r.fails(F.col(value))).otherwise(out)
    return out


def gate(items: DataFrame, rules: Sequence[Limit], digits: int = 6) -> DataFrame:
    """metric, value and passed of the means of all items; what is not measured passes."""
    names = [r.metric for r in rules]
    means = items.agg(*(F.avg(m).alias(m) for m in names)).unpivot([], names, "metric", "v")
    return means.select("metric", F.round("v", digits).alias("value"), (~F.coalesce(_beyond(rules, "v"), F.lit(False))).alias("passed"))


def item_failures(items: DataFrame, rules: Sequence[Limit], key: str = "item_id") -> DataFrame:
    """(key, metric) of every measured metric of an item that breaks its limit."""
    names = [r.metric for r in rules]
    each = items.select(key, *(F.col(m).cast("double").alias(m) for m in names)).unpivot([key], names, "metric", "v")
    return each.where(F.col("v").isNotNull() & _beyond(rules, "v")).select(key, "metric")


def compare(now: DataFrame, before: DataFrame, key: str = "item_id", passed: str = "passed") -> DataFrame:
    """(key, change) of two runs: new, missing, regression, fixed or same."""
    a, b = now.select(key, F.col(passed).alias("_is")), before.select(key, F.col(passed).alias("_was"))
    is_, was = F.col("_is"), F.col("_was")
    change = F.when(was.isNull(), "new").when(is_.isNull(), "missing").when(was & ~is_, "regression").when(~was & is_, "fixed").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"))


# --- scores of single rows --------------------------------------------------------------


def leak_kind(tenant: str = "tenant", user: str = "user", clearance: str = "clearance") -> Column:
    """Why a corpus row should not have been told to a caller, by the first reason; null if it may."""
    return F.when(F.col("tenant_id") != F.col(tenant), "tenant").when(F.col("classification_rank") > F.col(clearance), "clearance").when(F.array_contains("denied_users", F.col(user)), "denied")


def leak_score(told: DataFrame, by: str, leak: str = "leak") -> DataFrame:
    """1 where nothing leaked, else 0: one leak is as bad as many."""
    return told.groupBy(by).agg(F.when(F.count(leak) == 0, 1.0).otherwise(0.0).alias("score"))


def refusal_correct(refused: Column, expected: Column) -> Column:
    return refused == expected


def tool_score(called: Column, expected: Sequence[str], asked: Column) -> Column:
    """1 if one of the tools expected was called, by its name or as the last part of a dotted one; null where none was asked for."""

    def is_one(x: Column) -> Column:
        return reduce(lambda a, b: a | b, ((x == name) | x.endswith(f".{name}") for name in expected))

    hit = F.exists(called, is_one)
    return F.when(asked, F.when(hit, 1.0).otherwise(0.0))


def words_found(text: Column | str, words: Sequence[str], found: bool = True) -> Column:
    """The words that a text has in any case, or those that it lacks, joined by commas."""
    low = F.lower(text)
    return F.array_join(F.filter(F.array(*map(F.lit, words)), lambda x: F.contains(low, x) == found), ",")


def set_recall(want: str, got: str, digits: int = 6) -> Column:
    """The share of the wanted that was got."""
    return F.round(F.size(F.array_intersect(want, got)) / F.size(want), digits)


def similarity(a: str, b: str) -> Column:
    """Cosine within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def correctness(tp: Column, fp: Column, fn: Column, likeness: Column, weight: float = 0.75) -> Column:
    """F1 of statements and likeness to the expected answer, weighed."""
    return weight * (2.0 * tp / (2 * tp + fp + fn)) + (1 - weight) * F.least(F.lit(1.0), likeness)


# --- scores of groups -------------------------------------------------------------------


def average_precision(rows: DataFrame, by: str, order: str, useful: Column, digits: int = 6) -> DataFrame:
    """The mean precision at the ranks of useful rows; 0 where none is."""
    w = Window.partitionBy(by).orderBy(order)
    r = rows.withColumn("_u", useful).withColumn("_rank", F.row_number().over(w)).withColumn("_hits", F.sum(F.when(F.col("_u"), 1.0).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(by).agg(F.round(F.coalesce(F.avg(F.when(F.col("_u"), F.col("_hits") / F.col("_rank"))), F.lit(0.0)), digits).alias("score"))


def share(rows: DataFrame, by: str, ok: Column, empty: float | None = None, digits: int = 6) -> DataFrame:
    """The share of a group's rows for which a condition holds; those where it is null do not count, and ``empty`` is the score where none counts."""
    mean = F.avg(F.when(ok, 1.0).when(~ok, 0.0))
    return rows.groupBy(by).agg(F.round(mean if empty is None else F.coalesce(mean, F.lit(empty)), digits).alias("score"))


def highest(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.max(value).alias(name))


def usage(calls: DataFrame, by: str, tokens: Column) -> DataFrame:
    """Calls and tokens of each group."""
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).cast("long").alias("tokens"))


#: Fixed: what reading from and writing to the cache cost, as shares of an input token.
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def cost(calls: DataFrame, rates: Mapping[str, tuple[float, float]], by: str, model: str, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, digits: int = 9) -> DataFrame:
    """The cost of each group's calls at prices (in, out) a million tokens; calls of models without a price are left out."""
    prices = calls.sparkSession.createDataFrame([(k, i, o) for k, (i, o) in rates.items()], f"{model} string, _i double, _o double")
    i, o = F.col("_i"), F.col("_o")
    each = (tokens_in * i + tokens_out * o + cache_read * i * CACHE_READ + cache_write * i * CACHE_WRITE) / 1e6
    return calls.join(F.broadcast(prices), model).groupBy(by).agg(F.round(F.sum(each), digits).alias("cost"))


def histogram(rows: DataFrame, by: str, value: Column, width: float, last: int) -> DataFrame:
    """Counts of each group by buckets of a width, the last open."""
    return rows.groupBy(by, F.least(F.lit(last), F.floor(value / width)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def config_fingerprint(settings: Mapping[str, object], chars: int = 16, **columns: Column) -> Column:
    """A short hash of settings and of columns by name, in the order given."""
    parts = [F.lit("|".join(f"{k}={v}" for k, v in settings.items())), *(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in columns.items())]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, chars)


# --- reports ----------------------------------------------------------------------------


def report(items: DataFrame, before: DataFrame, rules: Sequence[Limit], category: str = "category", key: str = "item_id", k: int = 10) -> DataFrame:
    """(section, pos, line): a report as lines of Markdown: the verdict, the gate, categories, changes against a run before, and the worst items."""
    names = [r.metric for r in rules]
    g = gate(items, rules)
    mark = lambda c: F.when(c, "pass").otherwise("FAIL")
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c).cast("double"))).otherwise("–")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    bounds = limits(items.sparkSession, rules)
    hard = g.join(F.broadcast(bounds), "metric")
    # A hard limit that is broken fails the run; others are told.
    verdict = hard.agg(F.when(F.count_if(~F.col("passed") & F.col("hard")) > 0, "failed").when(F.count_if(~F.col("passed")) > 0, "passed with warnings").otherwise("passed").alias("v"))
    parts = [
        verdict.select(F.lit("1 verdict").alias("section"), F.lit("").alias("at"), F.concat(F.lit("# Evaluation: "), "v").alias("line")),
        hard.select(F.lit("2 gate"), "metric", row(F.col("metric"), number("value"), F.concat(F.when(F.col("upper"), "≤ ").otherwise("≥ "), F.col("floor").cast("string")), mark(F.col("passed")))),
        aggregate(items, names, (category,)).select(F.lit("3 categories"), F.col(category), row(F.coalesce(category, F.lit("–")), F.col("n").cast("string"), number("pass_rate"), *(number(m) for m in names))),
        compare(items, before, key).groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.lit("4 changes"), "change", row(F.col("change"), F.col("n").cast("string"))),
        worst(items, names, k, key).select(F.lit("5 worst"), F.lpad(F.col(key).cast("string"), 20, "0"), row(F.col(key).cast("string"), mark(F.col("passed")), *(number(m) for m in names))),
    ]
    lines = reduce(DataFrame.union, parts)
    return lines.select("section", F.row_number().over(Window.partitionBy("section").orderBy("at", "line")).alias("pos"), "line")


def write_report(lines: DataFrame, folder: str) -> None:
    """The report as one Markdown file, and as rows of JSON beside it; it is as long as there are categories and metrics."""
    lines.orderBy("section", "pos").coalesce(1).select("line").write.mode("overwrite").text(f"{folder}/markdown")
    lines.write.mode("overwrite").json(f"{folder}/json")
