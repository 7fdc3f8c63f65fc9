"""Session windows in keyed state: turns of a session are held until none has come for a while, then let go.

The key is (tenant, session), so that equal session ids of two tenants never meet.  A
window is a run of turns with no gap of ``ttl`` or more; it is emitted once, when the
watermark has passed its last turn by ``ttl``, whatever the order in which turns came.
Its row keeps the numbers of its last ``most_turns`` turns and sums of all; until then
the state has a small entry for each turn, and nothing of a window once it is closed.

``windows`` is the same over a bounded table: one row per window.  Streams give the
rows of all windows that the watermark has closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

TTL_SECONDS, MOST_TURNS = 1800, 20
OUT = "tenant_id string, session_id long, opened timestamp, closed timestamp, turns long, tokens long, kept array<long>"
_TURN = "at long, turn long, tokens long"


def _plain(turns: DataFrame) -> DataFrame:
    return turns.select("tenant_id", F.col("session_id").cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("turn").cast("long").alias("turn"), F.col("tokens").cast("long").alias("tokens"))


def windows(turns: DataFrame, ttl: int = TTL_SECONDS, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row per window of a bounded table (tenant_id, session_id, ts, turn, tokens): opened, closed (its last turn), turns, tokens, kept (its last turns)."""
    key = ["tenant_id", "session_id"]
    w = Window.partitionBy(*key).orderBy("at", "turn")
    t = _plain(turns).withColumn("at", F.unix_micros("ts"))
    t = t.withColumn("new", F.when(F.col("at") - F.lag("at").over(w) < ttl * 1_000_000, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    g = t.groupBy(*key, "island").agg(F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("at", "turn"))).alias("all"))
    last = F.transform(F.slice("all", F.greatest(F.lit(1), F.size("all") - most_turns + 1), F.lit(most_turns)), lambda x: x["turn"])
    return g.select(*key, "opened", "closed", "turns", "tokens", last.alias("kept"))


class SessionStore(StatefulProcessor):
    """Turns of a key that are not emitted yet, and a timer for when the oldest window may close."""

    def __init__(self, ttl: int = TTL_SECONDS, most_turns: int = MOST_TURNS):
        self.ttl, self.most = ttl * 1_000_000, most_turns

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", _TURN)

    def _islands(self) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for turn in sorted(tuple(x) for x in self.turns.get()):
            if out and turn[0] - out[-1][-1][0] < self.ttl:
                out[-1].append(turn)
            else:
                out.append([turn])
        return out

    def _wake(self, islands: list[list[tuple]]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if islands:
            self.handle.registerTimer(-(-(islands[0][-1][0] + self.ttl) // 1000))  # in milliseconds, rounded up

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), int(r.turn), int(r.tokens or 0)) for pdf in rows for r in pdf.itertuples()]
        self.turns.appendList(new)
        self._wake(self._islands())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, islands, out = timerValues.getCurrentWatermarkInMs() * 1000, self._islands(), []
        while islands and islands[0][-1][0] + self.ttl <= now:
            own = islands.pop(0)
            out.append((*key, pd.Timestamp(own[0][0], unit="us"), pd.Timestamp(own[-1][0], unit="us"), len(own), sum(x[2] for x in own), [x[1] for x in own[-self.most :]]))
        left = [turn for own in islands for turn in own]
        if left:
            self.turns.put(left)
        else:
            self.turns.clear()
        self._wake(islands)
        yield pd.DataFrame(out, columns=["tenant_id", "session_id", "opened", "closed", "turns", "tokens", "kept"])

    def close(self) -> None:
        """State lives in the store; nothing is held beside it."""


def session_store(turns: DataFrame, ttl: int = TTL_SECONDS, most_turns: int = MOST_TURNS, late: str = "10 minutes") -> DataFrame:
    """``windows`` of a stream: a row for each window that has closed.  Needs the RocksDB state store."""
    t = _plain(turns).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return t.groupBy("tenant_id", "session_id").transformWithStateInPandas(SessionStore(ttl, most_turns), OUT, "Append", "EventTime")
