"""An ingestion run: one listing classified against the manifest, its documents fetched, judged again by their real hash, cut into chunks, and written to all tables of the index.

The tables (chunks, documents, runs, manifest) are versioned (``sources.versions``), and
each keeps the batch that made a version.  The manifest is written last: a run that is
killed and run again classifies the same listing against the same manifest, finds the
tables that it had written and leaves them, and writes the others.  So a batch changes
every table once, also where ``foreachBatch`` repeats it.

One run takes any number of sources of a tenant: sources are a column, not a loop.

Defined results: a document whose content cannot be had fails and keeps its entry, so
that the next run asks again; one that is too large or whose content turns out to be
the known one is skipped; deleted ones lose their chunks and keep a tombstone; after a
full scan what was not listed is deleted as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language
from ..sources.versions import Table
from . import delta, parsing
from .graph import cut

MOST_BYTES = 50 << 20
CHUNKS = "source string, document_id long, pos int, text string, section array<string>, tokens int, acl string, version long"
DOCUMENTS = "source string, document_id long, sha string, etag string, acl string, version long, lang string, chunks long, tokens long, is_deleted boolean, last_run string"
MANIFEST = "source string, document_id long, sha string, etag string, acl string, version long, chunks long, is_deleted boolean, seen long"
RUNS = "batch string, source string, created long, updated long, acl_only long, deleted long, skipped long, failed long, chunks long, status string"
KEY = ["source", "document_id"]
DONE = ("created", "updated", "acl_only", "deleted")


@dataclass
class Index:
    """The tables of one tenant's index below a folder."""

    spark: SparkSession
    root: str
    tables: dict[str, Table] = field(init=False)

    def __post_init__(self):
        self.tables = {n: Table(self.spark, f"{self.root}/{n}") for n in SCHEMAS}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read(SCHEMAS[name])

    def write(self, name: str, change: Callable[[DataFrame], DataFrame], batch: str) -> None:
        self.tables[name].update(change, SCHEMAS[name], batch)


SCHEMAS = {"chunks": CHUNKS, "documents": DOCUMENTS, "runs": RUNS, "manifest": MANIFEST}


def plan(listing: DataFrame, manifest: DataFrame, force: bool = False, full_scan: bool = False) -> DataFrame:
    """The listing (source, document_id, sha, etag, acl, deleted) with action, reason, version and its entry's m_ columns; after a full scan also what is gone."""
    entry = manifest.select(*KEY, F.col("sha").alias("m_sha"), F.col("etag").alias("m_etag"), F.col("acl").alias("m_acl"), F.col("version").alias("m_version"), F.col("is_deleted").alias("m_deleted"), F.col("chunks").alias("m_chunks"))
    listing = listing.select(*KEY, "sha", "etag", "acl", "deleted")
    decided = delta.classify(listing, entry, KEY, force)
    if not full_scan:
        return decided
    # Only of sources that were listed: one that could not be is not empty.
    gone = entry.where("not m_deleted").join(listing.select("source").distinct(), "source", "left_semi").join(listing, KEY, "left_anti")
    absent = {"action": F.lit("delete"), "reason": F.lit("not listed"), "version": F.col("m_version"), "deleted": F.lit(True), "sha": F.lit(None).cast("string"), "etag": F.col("m_etag"), "acl": F.col("m_acl")}
    return decided.unionByName(gone.select(*(absent[c].alias(c) if c in absent else F.col(c) for c in decided.columns)))


def judged(planned: DataFrame, contents: DataFrame, force: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The plan after the fetch (document contents: source, document_id, text): by its real hash a document may be unchanged, or changed in access only."""
    wanted = F.col("action").isin("create", "update")
    got = contents.select(*KEY, "text", F.sha2("text", 256).alias("real"), F.octet_length("text").alias("bytes"))
    j = planned.join(got, KEY, "left")
    same = F.col("real").eqNullSafe(F.col("m_sha")) & ~F.coalesce("m_deleted", F.lit(True)) & ~F.lit(force)
    moved = ~F.col("acl").eqNullSafe(F.col("m_acl"))
    rules = [
        (wanted & F.col("real").isNull(), "fail", "no content"),
        (wanted & (F.col("bytes") > most_bytes), "skip", "too large"),
        (wanted & same & moved, "acl_only", "access changed"),
        (wanted & same, "skip", "content unchanged"),
    ]
    action, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, a, r in rules[1:]:
        action, reason = action.when(condition, a), reason.when(condition, r)
    out = j.withColumn("final", action.otherwise(F.col("action"))).withColumn("reason", reason.otherwise(F.col("reason")))
    return out.withColumn("version", delta.next_version(F.col("final"), F.col("m_version"))).withColumn("text", F.when(F.col("final").isin("create", "update"), F.col("text")))


def chunked(work: DataFrame) -> DataFrame:
    """The chunks of what is created or updated."""
    w = work.where(F.col("final").isin("create", "update"))
    # Parsing knows documents by one number; sources may use the same ones.
    numbered = w.select(F.xxhash64(*KEY).alias("n"), *KEY, "acl", "version", "text")
    made = parsing.chunks(numbered, "n", "text").withColumnRenamed("id", "n").withColumnRenamed("text", "chunk")
    return made.join(numbered.drop("text"), "n").select(*KEY, F.col("pos").cast("int").alias("pos"), F.col("chunk").alias("text"), "section", "tokens", "acl", "version")


def _outcome() -> F.Column:
    names = {"create": "created", "update": "updated", "acl_only": "acl_only", "delete": "deleted", "fail": "failed"}
    out = F.lit("skipped")
    for action, name in names.items():
        out = F.when(F.col("final") == action, name).otherwise(out)
    return out


def run_ingest(index: Index, listing: DataFrame, contents: DataFrame, batch: str, now: int, force: bool = False, full_scan: bool = False, dry_run: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Runs a batch; its row of counts for each source (``RUNS``).  A dry run only plans."""
    planned = plan(listing, index.read("manifest"), force, full_scan)
    if dry_run:
        return _summary(planned.withColumn("final", F.col("action")).withColumn("n", F.lit(0)), batch)
    if index.tables["manifest"].made_for(batch):  # the last to be written
        return index.read("runs").where(F.col("batch") == batch)
    work = cut(judged(planned, contents, force, most_bytes))  # all sinks see one classification
    made = cut(chunked(work))
    size = made.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    work = work.join(size, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    replaced = work.where(F.col("final").isin("create", "update", "delete")).select(*KEY)
    access = work.where("final = 'acl_only'").select(*KEY, F.col("acl").alias("new_acl"))

    def with_access(old: DataFrame) -> DataFrame:
        return old.join(access, KEY, "left").withColumn("acl", F.coalesce("new_acl", "acl")).drop("new_acl")

    index.write("chunks", lambda old: with_access(old.join(replaced, KEY, "left_anti")).select(*made.columns).unionByName(made), batch)
    rows = work.where(F.col("final").isin("create", "update")).select(
        *KEY, F.col("real").alias("sha"), "etag", "acl", "version", language("text").alias("lang"), F.col("n").alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(False).alias("is_deleted"), F.lit(batch).alias("last_run")
    )
    gone = work.where("final = 'delete'").select(*KEY, F.lit(True).alias("gone"))

    def documents(old: DataFrame) -> DataFrame:
        rest = with_access(old.join(rows, KEY, "left_anti")).join(gone, KEY, "left")
        touched = F.col("gone").isNotNull()
        rest = rest.withColumn("is_deleted", F.col("is_deleted") | touched).withColumn("last_run", F.when(touched, batch).otherwise(F.col("last_run")))
        return rest.withColumn("chunks", F.when(touched, 0).otherwise(F.col("chunks"))).withColumn("tokens", F.when(touched, 0).otherwise(F.col("tokens"))).select(*rows.columns).unionByName(rows)

    index.write("documents", documents, batch)
    index.write("runs", lambda old: old.unionByName(_summary(work, batch)), batch)
    entries = work.where("final <> 'fail' AND NOT (final = 'skip' AND m_version IS NULL)").select(
        *KEY, F.when(F.col("final").isin("create", "update"), F.col("real")).otherwise(F.col("m_sha")).alias("sha"), F.when(F.col("reason") == "too large", F.col("m_etag")).otherwise(F.col("etag")).alias("etag"), "acl", "version",
        F.when(F.col("final").isin("create", "update"), F.col("n")).when(F.col("final") == "delete", 0).otherwise(F.col("m_chunks")).alias("chunks"), (F.col("final") == "delete").alias("is_deleted"), F.lit(now).cast("long").alias("seen"),
    )
    index.write("manifest", lambda old: delta.upsert(old, entries, KEY), batch)
    return index.read("runs").where(F.col("batch") == batch)


def _summary(work: DataFrame, batch: str) -> DataFrame:
    """Counts by source of work with ``final`` and ``n`` chunks."""
    o = work.withColumn("outcome", _outcome())
    c = o.groupBy("source").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("created", "updated", "acl_only", "deleted", "skipped", "failed")), F.sum("n").cast("long").alias("chunks"))
    done = sum((F.col(x) for x in DONE), F.lit(0))
    return c.select(F.lit(batch).alias("batch"), *c.columns, delta.run_status(F.col("failed"), done + F.col("skipped")).alias("status"))


def ingest_stream(listing: DataFrame, index: Index, contents: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "ingest", **options):
    """Runs each batch of a stream of listings; ``contents`` gives the documents of a batch.  A batch is known by the stream's name and number."""

    def each(df: DataFrame, number: int) -> None:
        run_ingest(index, df, contents(df), f"{name}-{number}", number, **options)

    return listing.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each)
