"""Versioned tables under two writers, and ingestion runs that are killed and run again."""

import threading

import pytest
from pyspark.sql import functions as F

from loomstone.operators import ingest as I
from loomstone.sources import versions as V

ROWS = "id long, by string"


def table(spark, tmp_path):
    return V.Table(spark, f"file://{tmp_path}/t")


def test_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.current() is None and t.read(ROWS).collect() == []
    t.update(lambda old: old.union(spark.createDataFrame([(1, "a")], ROWS)), ROWS, "b1")
    t.update(lambda old: old.union(spark.createDataFrame([(2, "a")], ROWS)), ROWS, "b2")
    again = t.update(lambda old: pytest.fail("a batch is done once"), ROWS, "b1")
    assert again.number == 1 and t.numbers() == [1, 2]
    assert sorted(r.id for r in t.read(ROWS).collect()) == [1, 2] and [r.id for r in t.read(ROWS, 1).collect()] == [1]
    with pytest.raises(V.Conflict):
        t.commit(t.read(ROWS), 1)
    assert t.tidy(1) == 1 and t.numbers() == [2] and t.read(ROWS).count() == 2


def test_two_writers_race(spark, tmp_path):
    """Both start from one version; one is first, the other goes again from its result."""
    t, both, tries = table(spark, tmp_path), threading.Barrier(2), {"a": 0, "b": 0}
    t.update(lambda old: spark.createDataFrame([(0, "start")], ROWS), ROWS)

    def write(name):
        def change(old):
            tries[name] += 1
            if tries[name] == 1:
                both.wait(30)  # both have read the same version
            return old.union(spark.createDataFrame([(tries[name], name)], ROWS))

        V.Table(spark, t.folder).update(change, ROWS)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for x in threads:
        x.start()
    for x in threads:
        x.join(120)
    assert t.numbers() == [1, 2, 3] and sorted(tries.values()) == [1, 2]
    assert {r.by for r in t.read(ROWS).collect()} == {"start", "a", "b"}
    assert {r.by for r in t.read(ROWS, 2).collect()} < {"start", "a", "b"}
    assert t.tidy(3) == 0  # what the loser had written is gone


def test_a_version_is_taken_once(spark, tmp_path):
    t, out = table(spark, tmp_path), []

    def claim():
        try:
            t._claim(1, "{}")
            out.append("made")
        except V.Conflict:
            out.append("lost")

    threads = [threading.Thread(target=claim) for _ in range(12)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(60)
    assert sorted(out) == ["lost"] * 11 + ["made"]


def test_manifests_of_two_tenants_stay_apart(spark, tmp_path):
    row = (1, "t", "s", "x", "e", "a", 1, 2, False, 5)
    one = V.manifest(spark, f"file://{tmp_path}", "t", "s")
    V.save_manifest(one, spark.createDataFrame([row, (2, *row[1:])], V.MANIFEST))
    V.save_manifest(one, spark.createDataFrame([(1, "t", "s", "older", "e", "a", 9, 2, False, 4), (2, "t", "s", "tie", "e", "a", 3, 2, False, 5)], V.MANIFEST))
    assert {(r.document_id, r.sha) for r in V.load_manifest(one, "t", "s").collect()} == {(1, "x"), (2, "tie")}
    assert V.load_manifest(one, "other", "s").count() == 0


LIST = "source string, document_id long, sha string, etag string, acl string, deleted boolean"


def first(spark):
    listing = spark.createDataFrame([("s", k, None, "e1", "a", False) for k in range(1, 7)] + [("z", 1, None, "e1", "a", False)], LIST)
    texts = spark.createDataFrame([("s", k, f"Document {k} says a word. " * 40) for k in range(1, 6)] + [("z", 1, "Another one. " * 400)], "source string, document_id long, text string")
    return listing, texts


def second(spark):
    listing = spark.createDataFrame([("s", 1, None, "e2", "a", False), ("s", 2, None, "e2", "b", False), ("s", 3, None, "e2", "a", False), ("s", 4, None, "e1", "c", False), ("s", 5, None, "e1", "a", True), ("s", 6, None, "e1", "a", False), ("s", 9, None, "e1", "a", True)], LIST)
    texts = spark.createDataFrame([("s", 1, "New text. " * 40), ("s", 2, "Document 2 says a word. " * 40), ("s", 3, "Document 3 says a word. " * 40), ("s", 6, "There now. " * 40)], "source string, document_id long, text string")
    return listing, texts


def state(index):
    out = {n: sorted(map(tuple, index.read(n).drop("section").collect()), key=repr) for n in I.SCHEMAS}
    return out


def test_runs(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/i")
    dry = I.run_ingest(index, *first(spark), "one", 1, dry_run=True).collect()
    assert {(r.source, r.created) for r in dry} == {("s", 6), ("z", 1)} and index.read("manifest").count() == 0
    got = {r.source: r for r in I.run_ingest(index, *first(spark), "one", 1).collect()}
    assert (got["s"].created, got["s"].failed, got["s"].status) == (5, 1, "partial") and (got["z"].created, got["z"].status) == (1, "succeeded")
    assert {(r.source, r.document_id, r.version) for r in index.read("manifest").collect()} == {("s", k, 1) for k in range(1, 6)} | {("z", 1, 1)}
    chunks = index.read("chunks")
    assert chunks.where("source = 'z'").count() > 1 and chunks.select("source", "document_id").distinct().count() == 6

    r = I.run_ingest(index, *second(spark), "two", 2, full_scan=True).collect()[0]
    assert (r.created, r.updated, r.acl_only, r.deleted, r.skipped, r.failed) == (1, 1, 2, 1, 2, 0)
    m = {(x.source, x.document_id): x for x in index.read("manifest").collect()}
    assert m["s", 1].version == 2 and m["s", 2].version == 1 and m["s", 2].acl == "b" and m["s", 3].etag == "e2" and m["s", 5].is_deleted and not m["z", 1].is_deleted
    c = {(x.document_id, x.acl) for x in index.read("chunks").where("source = 's'").collect()}
    assert c == {(1, "a"), (2, "b"), (3, "a"), (4, "c"), (6, "a")}
    assert all(x.text.startswith("New") for x in index.read("chunks").where("document_id = 1 and source = 's'").collect())
    d = {x.document_id: x for x in index.read("documents").where("source = 's'").collect()}
    assert d[5].is_deleted and d[5].chunks == 0 and d[4].acl == "c" and d[1].last_run == "two" and d[3].last_run == "one"


def test_full_scan_deletes_what_is_gone(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}/i")
    I.run_ingest(index, *first(spark), "one", 1)
    listing, texts = first(spark)
    some = listing.where("source = 's' and document_id < 3")
    assert I.run_ingest(index, some, texts, "part", 2).collect()[0].deleted == 0
    assert I.run_ingest(index, some, texts, "full", 3, full_scan=True).collect()[0].deleted == 3
    assert {(r.source, r.document_id) for r in index.read("chunks").collect()} == {("s", 1), ("s", 2), ("z", 1)}  # z was not listed at all


@pytest.mark.parametrize("dies_at", ["chunks", "documents", "runs", "manifest"])
def test_a_killed_batch_run_again_leaves_the_same_tables(spark, tmp_path, monkeypatch, dies_at):
    def both(root, kill):
        index = I.Index(spark, f"file://{tmp_path}/{root}")
        I.run_ingest(index, *first(spark), "one", 1)
        if kill:
            write = I.Index.write

            def dying(self, name, change, batch):
                if name == dies_at:
                    raise RuntimeError("killed")
                write(self, name, change, batch)

            with monkeypatch.context() as m:
                m.setattr(I.Index, "write", dying)
                with pytest.raises(RuntimeError):
                    I.run_ingest(index, *second(spark), "two", 2)
        I.run_ingest(index, *second(spark), "two", 2)
        rows = I.run_ingest(index, *second(spark), "two", 2).collect()  # once more: nothing is left to do
        assert len(rows) == 1 and all(t.numbers() == [1, 2] for t in index.tables.values())
        return state(index)

    assert both("killed", True) == both("whole", False)


def test_a_stream_of_listings(spark, tmp_path, monkeypatch):
    index, (one, texts) = I.Index(spark, f"file://{tmp_path}/i"), first(spark)
    wanted = lambda df: texts.join(df.select("source", "document_id"), ["source", "document_id"], "left_semi")
    write, dies = I.Index.write, [True]

    def dying(self, name, change, batch):
        write(self, name, change, batch)
        if name == "documents" and dies.pop():
            raise RuntimeError("killed")

    def go():
        stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = I.ingest_stream(stream, index, wanted, f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(180)

    one.where("document_id <= 2").coalesce(1).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(I.Index, "write", dying)
    with pytest.raises(Exception, match="killed"):
        go()
    dies.append(False)
    one.where("document_id > 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    dies += [False] * 8
    go()
    go()
    whole = I.Index(spark, f"file://{tmp_path}/w")
    I.run_ingest(whole, one, texts, "all", 1)
    keep = lambda index: sorted(map(tuple, index.read("chunks").select("source", "document_id", "pos", "text", "version").collect()))
    assert keep(index) == keep(whole)
    assert index.read("runs").agg(F.sum("created"), F.sum("failed")).collect()[0] == (6, 1)
