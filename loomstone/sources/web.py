"""Pages and sitemaps as tables: links, breadth-first crawl, entries since a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut

LINK = r"""href\s*=\s*["']([^"'#]+)"""


def links(html: str | Column, base: str | Column) -> Column:
    """Absolute http links without fragments, each once, in order; other schemes are left out."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    found = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: F.when(x.rlike("^https?://"), x).when(x.startswith("//"), F.concat(F.lit("https:"), x)).when(x.startswith("/"), F.concat(root, x)).when(x.rlike("^[a-z]+:"), F.lit(None)).otherwise(F.concat(root, F.lit("/"), x)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def crawl(pages: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth) of what is reached from the seeds; each level joins its frontier with the links, drops what was seen and is cut from what made it."""
    edges = pages.select(F.col("url").alias("src"), F.explode(links("html", "url")).alias("url"))
    edges = cut(edges.distinct())
    seen = front = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.select(F.col("url").alias("src")).join(edges, "src").select("url").distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        front = cut(front)
        seen = seen.union(front)
    return seen


def sitemap(maps: DataFrame, since: str) -> DataFrame:
    """The entries of sitemaps in a column ``xml`` that are as new as ``since``; one without a date counts as new."""
    entry = "array<struct<loc:string,lastmod:string>>"
    parsed = maps.withColumn("e", F.explode(F.from_xml("xml", f"struct<url:{entry}>")["url"]))
    return parsed.where(F.col("e.lastmod").isNull() | (F.to_date(F.substring("e.lastmod", 1, 10)) >= F.lit(since).cast("date"))).withColumn("url", F.col("e.loc"))
