"""The change feed, session state and the folds of calls: restarts, replays and the same rows as over bounded tables."""

import json
import os
import random
import uuid
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomstone.sources import feed
from loomstone.streaming import events as SE
from loomstone.streaming import sessions as SW

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put_page(folder, link, head, items):
    os.makedirs(f"{folder}/{link}", exist_ok=True)
    with open(f"{folder}/{link}/part-0.txt", "w") as f:
        f.write("\n".join(map(json.dumps, [head, *items])) + "\n")


def pages(folder):
    put_page(folder, "page=0", {"next": "page=a"}, [{"id": "1", "name": "one", "size": 5, "etag": "x"}, {"id": " ", "size": 1}, {"id": "2", "size": 99}])
    put_page(folder, "page=a", {"delta": "page=b"}, [{"id": "3", "size": 7}, {"id": "1", "deleted": {"state": "deleted"}}])


def more(folder):
    put_page(folder, "page=b", {"delta": "page=c"}, [{"id": "3", "size": 8, "etag": "y"}, {"id": "4", "deleted": {}}])


FIRST = {("1", 5, False, 0, 0), ("3", 7, False, 1, 0), ("1", None, True, 1, 1)}
LATER = {("3", 8, False, 2, 0), ("4", None, True, 2, 1)}


def rows(df):
    return [(r.item_id, r.size, r.deleted, r.page, r.pos) for r in df.collect()]


def test_feed_in_one_go(spark, tmp_path):
    folder = f"file://{tmp_path}"
    pages(tmp_path)
    assert set(rows(feed.changes(spark, folder, mostBytes="50"))) == FIRST
    assert feed.cursor(folder) == "page=b"
    assert rows(feed.changes(spark, folder, cursor="page=b")) == []
    more(tmp_path)
    assert {x[:3] for x in rows(feed.changes(spark, folder, cursor="page=b"))} == {x[:3] for x in LATER}
    last = {(r.item_id, r.size, r.deleted) for r in feed.latest(feed.changes(spark, folder, mostBytes="50")).collect()}
    assert last == {("1", None, True), ("3", 8, False), ("4", None, True)}
    put_page(tmp_path, "page=c", {"delta": "page=d"}, [3])
    with pytest.raises(Exception, match="page=c, line 2"):
        feed.changes(spark, folder).collect()


def run(df, folder, name, **options):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).options(**options).start(f"{folder}/{name}")
    assert q.awaitTermination(180) and q.exception() is None


def test_feed_goes_on_from_its_stored_offset(spark, tmp_path):
    os.makedirs(tmp_path / "feed")
    folder, stream = f"file://{tmp_path}/feed", lambda: feed.changes(spark, f"file://{tmp_path}/feed", stream=True, mostBytes="50")
    pages(tmp_path / "feed")
    run(stream(), tmp_path, "out")
    assert set(rows(spark.read.parquet(f"{tmp_path}/out"))) == FIRST
    more(tmp_path / "feed")
    run(stream(), tmp_path, "out")  # another reader: it knows what the checkpoint knows
    assert sorted(rows(spark.read.parquet(f"{tmp_path}/out")), key=repr) == sorted(FIRST | LATER, key=repr)
    assert set(rows(feed.changes(spark, folder, mostBytes="50"))) == FIRST | LATER
    run(stream(), tmp_path, "out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_feed_reads_a_failed_batch_again(spark, tmp_path):
    os.makedirs(tmp_path / "feed")
    pages(tmp_path / "feed")
    seen = defaultdict(list)

    def start(fails):
        def sink(df, batch):
            seen[batch].append(sorted(rows(df), key=repr))
            if fails:
                raise RuntimeError("the sink is gone")

        df = feed.changes(spark, f"file://{tmp_path}/feed", stream=True, mostBytes="50")
        return df.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(sink).start()

    with pytest.raises(Exception, match="sink is gone"):
        start(True).awaitTermination(120)
    more(tmp_path / "feed")  # what came meanwhile is of the next batch
    for _ in range(2):  # the first run may end with the batch that was left over
        assert start(False).awaitTermination(120)
    first = next(iter(sorted(seen)))
    assert seen[first] == [sorted(FIRST, key=repr)] * 2
    assert [x for b in sorted(seen)[1:] for x in seen[b][-1]] == sorted(LATER, key=repr)


def test_pages_that_spark_writes(spark, tmp_path):
    items = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("e").alias("etag"), F.col("id").alias("size"), F.lit("2025").alias("modified"), (F.col("id") == 3).alias("deleted"), (F.col("id") / 4).cast("long").alias("page"), (10 - F.col("id")).alias("pos"))
    feed.write_pages(items, f"file://{tmp_path}/f")
    got = feed.changes(spark, f"file://{tmp_path}/f").orderBy("page", "pos").collect()
    assert [(r.item_id, r.page) for r in got] == [(str(k), k // 4) for k in (3, 2, 1, 0, 7, 6, 5, 4, 9, 8)]
    assert [r.item_id for r in got if r.deleted] == ["3"] and feed.cursor(f"file://{tmp_path}/f") == "page=3"


def turns(spark):
    rnd, start, out = random.Random(2), datetime(2025, 1, 1), []
    for tenant in "ab":
        for session in range(6):
            at = start + timedelta(minutes=rnd.randint(0, 90))
            for turn in range(rnd.randint(1, 40)):
                out.append((tenant, session, at, turn, turn % 5))
                at += timedelta(minutes=rnd.choice((1, 5, 29, 30, 45)))
    return spark.createDataFrame(out, "tenant_id string, session_id long, ts timestamp, turn long, tokens long")


def test_sessions_close_by_event_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        t = turns(spark)
        made = [r.asDict() for r in t.orderBy("ts").collect()]
        cut = [made[:150], made[150:220], made[220:]]
        random.Random(1).shuffle(cut[0])  # within a batch turns come in any order
        end = max(r["ts"] for r in made) + timedelta(days=1)
        cut.append([{"tenant_id": "z", "session_id": 0, "ts": end, "turn": 0, "tokens": 0}])
        for k, part in enumerate(cut):
            spark.createDataFrame(part, t.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            # A new query each time: state, timers and watermark come from the checkpoint.
            run(SW.session_store(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), most_turns=4), tmp_path, "out")
            if k == 0:
                early = spark.read.parquet(f"{tmp_path}/out").count()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
        want = sorted(map(tuple, SW.windows(t, most_turns=4).collect()))
        assert got == want and 0 < early < len(want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows(spark):
    by = defaultdict(list)
    for r in turns(spark).collect():
        by[r.tenant_id, r.session_id].append(r)
    want = []
    for key, own in by.items():
        islands = []
        for r in sorted(own, key=lambda r: r.ts):
            if islands and (r.ts - islands[-1][-1].ts).total_seconds() < 1800:
                islands[-1].append(r)
            else:
                islands.append([r])
        want += [(*key, x[0].ts, x[-1].ts, len(x), sum(r.tokens for r in x), [r.turn for r in x[-20:]]) for x in islands]
    assert sorted(map(tuple, SW.windows(turns(spark)).collect())) == sorted(want)


def slow_bucket(calls, capacity=3.0, a_second=1 / 1800):
    out, held = {}, {}
    for r in calls:
        left, last = held.get((r.user_id, r.event_type), (capacity, r.ts))
        left = min(capacity, left + (r.ts - last).total_seconds() * a_second)
        out[r.event_id] = left >= 1
        held[r.user_id, r.event_type] = (left - (left >= 1), r.ts)
    return out


def slow_circuit(calls):
    out, held = {}, {}
    for r in calls:
        bad, since = held.get(r.user_id, (0, None))
        out[r.event_id] = state = "closed" if since is None else "half_open" if (r.ts - since).total_seconds() >= 3600 else "open"
        if state != "open":
            bad, since = (bad + 1, r.ts if state == "half_open" or bad + 1 >= 2 else since) if r.value > 60 else (0, None)
        held[r.user_id] = (bad, since)
    return out


@pytest.mark.parametrize(("fold", "slow", "column"), [(SE.rate_limited, slow_bucket, "allowed"), (SE.breaker, slow_circuit, "state")])
def test_calls(spark, sf, tmp_path, fold, slow, column):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 400).cast("long")).alias("ts"), "value")
    calls = events.orderBy("ts", "event_id").collect()
    want = slow(calls)
    assert {r.event_id: r[column] for r in fold(events).collect()} == want and len(set(want.values())) > 1
    for k in range(3):
        part = calls[k * len(calls) // 3 : (k + 1) * len(calls) // 3]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(fold(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")), tmp_path, "out")
    assert {r.event_id: r[column] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_names_are_new(spark):
    from loomstone.operators.graph import new_folder

    assert len({new_folder(spark, "x") for _ in range(3)}) == 3 and uuid.UUID(new_folder(spark, "x")[-32:])
