"""The event stream: windows with late data, sessions, and state for each key.

Functions take streaming and bounded tables alike.  The two that fold a key's calls in
order keep the same state between the batches of a stream that they have within one;
calls of a batch are sorted, and a batch is taken to be later than those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and sum for each hour and type; rows later than the watermark are left out of a stream."""
    return _marked(events, late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A session ends after a gap; one second more makes a gap of just that length part of it."""
    return _marked(events, late).groupBy("user_id", F.session_window("ts", f"{gap} 1 microsecond").alias("session")).agg(F.count(F.lit(1)).alias("n"))


def _bucket(pdf: pd.DataFrame, held: tuple | None, capacity: float, a_second: float) -> tuple[pd.DataFrame, tuple]:
    """Which calls of one key a token bucket allows, and what it then holds: tokens left and the time of the last call."""
    left, last = held or (capacity, None)
    pdf, out = pdf.sort_values(["ts", "event_id"]), []
    for now in pdf["ts"]:
        left = min(capacity, left + max(0.0, now - last) * a_second) if last is not None else left
        last = now if last is None else max(last, now)
        out.append(left >= 1)
        left -= left >= 1
    return pd.DataFrame({"event_id": pdf["event_id"], "allowed": out}), (left, last)


def _circuit(pdf: pd.DataFrame, held: tuple | None, failures: int, open_seconds: float, fails_over: float) -> tuple[pd.DataFrame, tuple]:
    """The state before each call of one key, and what it then holds: failures in a row and since when it is open (-1: it is not)."""
    bad, since = held or (0, -1.0)
    pdf, out = pdf.sort_values(["ts", "event_id"]), []
    for now, value in zip(pdf["ts"], pdf["value"], strict=True):
        state = "closed" if since < 0 else "half_open" if now - since >= open_seconds else "open"
        out.append(state)
        if state == "open":
            continue
        if value > fails_over:
            bad += 1
            if state == "half_open" or bad >= failures:
                since = now
        else:
            bad, since = 0, -1.0
    return pd.DataFrame({"event_id": pdf["event_id"], "state": out}), (bad, since)


def _folded(events: DataFrame, key: list[str], step, schema: str, state: str) -> DataFrame:
    """``step`` over each key's calls in order of time; of a stream in the order of its batches, its state kept between them."""
    calls = events.select("event_id", *key, "value", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("ts")).groupBy(*key)
    if not events.isStreaming:
        return calls.applyInPandas(lambda pdf: step(pdf, None)[0], schema)

    def update(_: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        out, kept = step(pd.concat(list(batches)), held.get if held.exists else None)
        held.update(kept)
        yield out

    return calls.applyInPandasWithState(update, schema, state, "append", "NoTimeout")


def rate_limited(events: DataFrame, capacity: float = 3.0, a_second: float = 1 / 1800) -> DataFrame:
    """(event_id, allowed): a token bucket for each user and tool, refilled with time."""
    return _folded(events, ["user_id", "event_type"], lambda pdf, held: _bucket(pdf, held, capacity, a_second), "event_id long, allowed boolean", "left double, last double")


def breaker(events: DataFrame, failures: int = 2, open_seconds: float = 3600.0, fails_over: float = 60.0) -> DataFrame:
    """(event_id, state before the call): closed until so many failures in a row, then open, half open after a while."""
    return _folded(events, ["user_id"], lambda pdf, held: _circuit(pdf, held, failures, open_seconds, fails_over), "event_id long, state string", "bad long, since double")


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) kept for each user of a stream in state that outlives batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    schema = "user_id long, n long, total double"
    return events.groupBy("user_id").applyInPandasWithState(update, schema, "n long, total double", "update", "NoTimeout")
