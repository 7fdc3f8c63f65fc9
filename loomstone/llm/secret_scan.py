"""Secret scans by ownership: who holds a value tells copied examples from live credentials.

Patterns propose candidates in every whole text.  The hash of each candidate's value
is counted over the whole corpus by distinct owners and distinct repositories: a value
that at least ``COPIED`` owners hold is a widely copied example; one that fewer hold
and that looks random is taken for live.  Beside the base patterns, plain runs of
letters and digits are candidates, and a value that is live is a span of its own
wherever it stands, whatever stood before it elsewhere.

Everything is SQL functions in the JVM.  Positions come from cutting a text at its
matches: what lies between them, and they, have lengths, and running sums of these
are the code points where matches start and end.  Values that very many rows hold
(more than one in ``HOT`` of all candidates, so at most ``HOT`` values) are joined
back by broadcast, all others by their hash, so no task gets a frequent value's rows.

Defined results: a null or empty text has no spans; a null owner or repository is one
unknown owner or repository; every row is a document, repeated ids too; of spans of
one kind and place one is told; an empty table gives no rows.  Columns are read by the
names given, others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lasting, staged, temporary


def either(word: str) -> str:
    """A word's pattern with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed: the base kinds in order, each with its pattern, the group of its value and the value's least length.
KEYS = ("password", "passwd", "secret", "token", "api_?key")
BASE = {
    "assign": ("(" + "|".join(map(either, KEYS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),  # a run too short for its first AKIA is too short for every later one
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Candidates beyond the base kinds: runs of letters and digits of both cases.
WIDE = r"[A-Za-z0-9_+-]{20,}"
LIVE = "live"
#: Owners from which on a value is a copied example; distinct characters that a live value has.
COPIED, DISTINCT = 3, 10
#: Fixed: words of values that are there to be replaced.
STAND_INS = "example|sample|dummy|changeme|placeholder|your"
HOT = 10_000
KINDS = (*BASE, "wide")


def _matches(text: Column, kind: str) -> Column:
    """For each match of a kind: its kind, its place among them, the length before it and its own, and its value."""
    pattern, group, _ = BASE.get(kind, (WIDE, 0, 0))
    gaps = F.split(text, pattern, -1)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    zipped = F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))
    each = F.transform(zipped, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("k"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(pattern), each).otherwise(none)


def found_in(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository: Column) -> DataFrame:
    """row (a number of its own), doc_id, owner, repository and the matches of all kinds, without the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), repository.alias("repository"), text.alias("text"))
    return d.select("row", "doc_id", "owner", "repository", F.concat(*(_matches(F.col("text"), k) for k in KINDS)).alias("found"))


def candidates(found: DataFrame) -> DataFrame:
    """row, owner, repository, kind, start, end, value and its hash: a row for each candidate."""
    each = found.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k"))
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(BASE[k][2]) if k in BASE else F.lit(0) for k in KINDS)), F.col("kind") + 1)
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    keep = (F.length("value") >= least) & ((F.col("kind") < len(BASE)) | mixed)
    return placed.where(keep).select("row", "owner", "repository", "kind", "start", "end", "value", F.md5("value").alias("hash"))


def ownership(candidate: DataFrame) -> DataFrame:
    """hash, owners, repositories and n (candidates) of every value: counted in three steps, each of which sums before it shuffles."""
    by_repository = candidate.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def looks_live(value: Column) -> Column:
    """Letters and digits, many different ones, and no word of a stand-in."""
    mix = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    return mix & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & ~F.lower(value).rlike(STAND_INS)


def judged(candidate: DataFrame, owned: DataFrame) -> DataFrame:
    """The candidates with the figures of their values."""
    total = owned.agg(F.sum("n").alias("n")).first().n or 0
    hot = F.col("n") * HOT > total
    few = F.broadcast(owned.where(hot))  # at most HOT rows
    rest = candidate.join(few.select("hash"), "hash", "left_anti").join(owned.where(~hot), "hash")
    return candidate.join(few, "hash").unionByName(rest)


def _told(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), copied: int = COPIED) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied (values of its candidates that are live, and that are widely copied)."""
    repository = F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"r{k}") for k, c in enumerate(repository_cols))))
    with temporary(docs.sparkSession, large=False):
        found = lasting(found_in(docs, id_col, text_col, owner_col, repository), "found")
        c = staged(candidates(found), "candidates")
        is_live = (F.col("owners") < copied) & looks_live(F.col("value"))
        name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
        base = F.struct("start", F.col("kind").alias("order"), "end", name.alias("name"))
        value_start = (F.col("end") - F.length("value")).alias("start")
        live = F.struct(value_start, F.lit(len(BASE)).alias("order"), "end", F.lit(LIVE).alias("name"))
        spans = judged(c, staged(ownership(c), "owned")).groupBy("row").agg(
            *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(BASE)),
            F.collect_list(F.when(F.col("kind") < len(BASE), base)).alias("base"),
            F.collect_set(F.when(is_live, live)).alias("live"),
            F.size(F.collect_set(F.when(is_live, F.col("hash")))).cast("long").alias("n_live"),
            F.size(F.collect_set(F.when(F.col("owners") >= copied, F.col("hash")))).cast("long").alias("n_copied"),
        )
        told = lasting(spans.select("row", "n_assign", "n_access", "n_hex", "n_live", "n_copied", _told(F.col("base")).alias("base"), _told(F.concat("base", "live")).alias("spans")), "spans")
    zero = {x: F.coalesce(x, F.lit(0)).alias(x) for x in ("n_assign", "n_access", "n_hex", "n_live", "n_copied")}
    text = {x: F.coalesce(x, F.lit("")) for x in ("base", "spans")}
    out = found.select("row", "doc_id").join(told, "row", "left")
    return out.select("doc_id", zero["n_assign"], zero["n_access"], zero["n_hex"], F.sha2(text["base"], 256).alias("base_sha256"), text["spans"].alias("spans"), zero["n_live"], zero["n_copied"])


def query(spark, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def _sql_matches(kind: str) -> str:
    pattern, group, _ = BASE.get(kind, (WIDE, 0, 0))
    p = pattern.replace("'", "''")
    return f"""SELECT r, owner, repository, {KINDS.index(kind)} AS kind, generate_subscripts(w, 1) AS k, unnest(list_transform(g[1:len(w)], lambda x: length(x))) AS gap, unnest(list_transform(w, lambda x: length(x))) AS size, unnest(v) AS value
  FROM (SELECT r, owner, repository, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS w, regexp_extract_all(text, '{p}', {group}) AS v FROM d WHERE regexp_matches(text, '{p}'))"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_LEAST = "[" + ", ".join(str(BASE[k][2]) if k in BASE else "0" for k in KINDS) + "]"
_SPAN = "string_agg({name} || ':' || start || ':' || \"end\", ',' ORDER BY start, kind)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source AS owner, to_json([source, lang]) AS repository FROM documents),
m AS ({' UNION ALL '.join(map(_sql_matches, KINDS))}),
p AS (SELECT *, (sum(gap + size) OVER (PARTITION BY r, kind ORDER BY k))::BIGINT AS "end" FROM m),
c AS (SELECT r, owner, repository, kind, "end" - size AS start, "end", value FROM p WHERE length(value) >= ({_LEAST})[kind + 1] AND (kind < {len(BASE)} OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))),
o AS (SELECT value, count(DISTINCT owner) + max(CASE WHEN owner IS NULL THEN 1 ELSE 0 END) AS owners FROM c GROUP BY value),
j AS (SELECT c.*, owners >= {COPIED} AS copied, owners < {COPIED} AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= {DISTINCT} AND NOT regexp_matches(lower(value), '{STAND_INS}') AS live FROM c JOIN o USING (value)),
a AS (SELECT r, kind, start, "end", ({_NAMES})[kind + 1] AS name FROM j WHERE kind < {len(BASE)} UNION ALL SELECT DISTINCT r, {len(BASE)}, "end" - length(value), "end", '{LIVE}' FROM j WHERE live),
s AS (SELECT r, {_SPAN.format(name="name")} AS spans, string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}) AS base, {', '.join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(BASE))} FROM a GROUP BY r),
n AS (SELECT r, count(DISTINCT value) FILTER (WHERE live) AS n_live, count(DISTINCT value) FILTER (WHERE copied) AS n_copied FROM j GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN s USING (r) LEFT JOIN n USING (r)
"""
