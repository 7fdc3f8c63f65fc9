"""Arguments, templates and results of tools, as columns."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING = "No chunks in the indexed corpus matched that query for this user. Do not invent an answer; say what is and is not covered."
#: Types of JSON values by what a parsed value calls them.
KINDS = {"integer": r"^(?:BIGINT|INT|SMALLINT|TINYINT)$", "number": r"^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def quoted(c: Column) -> Column:
    """Percent-encoded, a space as %20, so that a value brings no new segment of a path."""
    return F.regexp_replace(F.url_encode(c.cast("string")), r"\+", "%20")


def render(template: str, args: Mapping[str, Column], quote: bool = False) -> dict[str, Column]:
    """``text`` of a template with {name} places, empty where a name has no argument, and the ``missing`` names.

    A path is asked for strictly: ``text`` is only to be used without ``missing``.
    """
    parts, names = [], []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            names.append(name)
            value = args.get(name, F.lit(None)).cast("string")
            parts.append(quoted(value) if quote else value)
    missing = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(args.get(n, F.lit(None)).isNull(), n) for n in names)), lambda x: x.isNotNull()))) if names else F.array().cast("array<string>")
    return {"text": F.when(F.size(missing) > 0, "").otherwise(F.concat(*parts)), "missing": missing}


def errors(arguments: Column, schema: Mapping[str, Any]) -> Column:
    """What is wrong with a JSON object of arguments under a schema of flat properties, sorted; undeclared names are."""
    properties = schema.get("properties", {})
    value = F.try_parse_json(arguments)
    names = F.json_object_keys(arguments)
    found = [F.when(~F.array_contains(names, n), f"{n}: required") for n in schema.get("required", ())]
    for n, node in properties.items():
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant"))
        raw = F.get_json_object(arguments, f"$.{n}")
        right = kind.rlike(KINDS[node["type"]]) if "type" in node else F.lit(True)
        there = F.array_contains(names, n)
        found.append(F.when(there & ~F.coalesce(right, F.lit(False)), f"{n}: expected {node.get('type')}"))
        ok, number = there & F.coalesce(right, F.lit(False)), raw.try_cast("double")
        rules = [
            ("enum", lambda v: ~raw.isin(*map(str, v)), lambda v: f"not one of {sorted(map(str, v))}"),
            ("minLength", lambda v: F.length(raw) < v, lambda v: f"shorter than minLength {v}"),
            ("maxLength", lambda v: F.length(raw) > v, lambda v: f"longer than maxLength {v}"),
            ("pattern", lambda v: ~raw.rlike(v), lambda v: "does not match the required pattern"),
            ("minimum", lambda v: number < v, lambda v: f"below minimum {v}"),
            ("maximum", lambda v: number > v, lambda v: f"above maximum {v}"),
        ]
        found += [F.when(ok & test(node[rule]), f"{n}: {says(node[rule])}") for rule, test, says in rules if rule in node]
    unknown = F.transform(F.array_except(names, F.array(*map(F.lit, properties)).cast("array<string>")), lambda x: F.concat(x, F.lit(": not declared")))
    listed = F.array_sort(F.concat(F.filter(F.array(*found).cast("array<string>"), lambda x: x.isNotNull()), unknown))
    return F.when(names.isNull(), F.array(F.lit("<root>: expected object"))).otherwise(listed)


def render_sources(queries: DataFrame, hits: DataFrame, chars: int = 300) -> DataFrame:
    """(query, text): the hits (query, rank, title, section, uri, chunk_id, text) of each query as numbered sources."""
    title = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title")
    head = F.when(F.coalesce("section", F.lit("")) != "", F.concat(title, F.lit(" — "), "section")).otherwise(title)
    snippet = F.substring(F.translate(F.trim("text"), "\n", " "), 1, chars)
    lines = F.concat_ws("\n", head, F.concat(F.lit("    source: "), "uri"), F.concat(F.lit("    chunk_id: "), "chunk_id"), F.concat(F.lit("    "), snippet))
    g = hits.select("query", F.struct("rank", lines.alias("line")).alias("x")).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    return queries.select("query").distinct().join(g, "query", "left").select("query", F.coalesce("text", F.lit(NOTHING)).alias("text"))


def route(tools: Column, enough: Column) -> Column:
    """Where a question goes: one for tools to them, and to retrieval as well if it also asks for text; else to retrieval or nowhere."""
    return F.when(tools & enough, "both").when(tools, "tools").when(enough, "retrieval").otherwise("neither")


def loops(calls: DataFrame, same: Sequence[str], order: str, most: int) -> DataFrame:
    """Calls with ``looped``: whether a call has been made ``most`` times before with the same arguments."""
    return calls.withColumn("looped", F.row_number().over(Window.partitionBy(*same).orderBy(order)) > most)


def projected(result: str, path: str) -> Column:
    """What a tool's JSON result has at a path."""
    return F.get_json_object(result, f"$.{path}")


def visible(principals: DataFrame, tools: Mapping[str, Sequence[str]]) -> DataFrame:
    """(principal, tool) of the tools that each may use: those that ask for no role, or for one that it has."""
    rows = principals.sparkSession.createDataFrame([(k, list(v)) for k, v in tools.items()], "tool string, need array<string>")
    return principals.join(F.broadcast(rows), (F.size("need") == 0) | F.arrays_overlap("need", "roles"))


def coerced(arguments: str, name: str, kind: str, default: object = None) -> Column:
    """An argument as a type, the default where it is missing or of none."""
    value = F.get_json_object(arguments, f"$.{name}").try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default))


#: Fixed: names of arguments whose values are never written down.
HIDDEN = ("token", "secret", "password", "api_key")


def redacted(arguments: Column, names: Sequence[str] = HIDDEN) -> Column:
    """JSON arguments with the values of some names masked."""
    return F.regexp_replace(arguments, rf'("(?:{"|".join(names)})"\s*:\s*)"[^"]*"', '$1"***"')


def refused(rank: Column, ceiling: int, text: Column, pattern: str = "@") -> Column:
    """Why arguments may not leave: a classification above the tool's, or personal data; null if they may."""
    return F.when(rank > ceiling, "classification").when(text.rlike(pattern), "personal data")


def gated(calls: DataFrame, same: Sequence[str], order: str, most: int, hidden: Column, screened: Column) -> DataFrame:
    """Calls with ``gate``: the first that a call fails (hidden, loop, screened), or ``ran``."""
    gate = F.when(hidden, "hidden").when(F.col("looped"), "loop").when(screened, "screened").otherwise("ran")
    return loops(calls, same, order, most).withColumn("gate", gate).drop("looped")
