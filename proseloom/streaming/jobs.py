"""What the interactive shell does with events, over batches and streams.

There is no event time in these rules: a result is late when a newer job of its session has begun, whenever that was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proseloom.operators.running import before, sliced
from proseloom.session import written

OUT = "session string, job long, seq long, payload string"
STATE = "job long, seq long"


def current_results(events: DataFrame) -> DataFrame:
    """Of (session, seq, kind, job, payload): the results whose job was the newest of its session when they arrived.

    ``begin`` events raise the newest job; a ``result`` of an older one is dropped for good. Batch form; sequence numbers are distinct within a session.
    """
    begun = F.when(F.col("kind") == "begin", F.col("job"))
    newest = before(events, ["session"], ["seq"], begun, "_n")
    return newest.where("kind = 'result' AND job = _n").select("session", "job", "seq", "payload")


def current_results_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the newest job and the last sequence number of a session as state.

    Events that come again, or with a sequence number that was passed, change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, last = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            if r.seq <= last:
                continue
            last = r.seq
            if r.kind == "begin":
                newest = max(newest, r.job)
            elif r.kind == "result" and r.job == newest:
                out.append((key[0], int(r.job), int(r.seq), r.payload))
        state.update((int(newest), int(last)))
        yield pd.DataFrame(out, columns=["session", "job", "seq", "payload"])

    return events.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_job(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; pre-aggregated before the shuffle, so that a hot key is no hot task."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def changed_only(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Events whose value differs from the one before: what a poll with a change number would see."""
    last = before(events, [key], [order], F.struct(F.col(order).alias("o"), F.col(value).alias("v")), "_b")
    return last.where(F.col("_b").isNull() | (F.col("_b.v") != F.col(value))).drop("_b")


CHANGE_STATE = "last long, held string"


def changed_stream(events: DataFrame, key: str, order: str, value: str, own: str | None = None) -> DataFrame:
    """(key, seq, value) of a stream's events whose value is another than the one before, with the last one as state.

    Events with a number that was passed change nothing; those marked in ``own`` are known already and are not given out.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if r.seq <= last:
                continue
            if not r.own and r.value != held:
                out.append((k[0], int(r.seq), r.value))
            last, held = r.seq, r.value
        state.update((int(last), held))
        yield pd.DataFrame(out, columns=["key", "seq", "value"])

    mine = (F.coalesce(F.col(own), F.lit(False)) if own else F.lit(False)).alias("own")
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), F.col(value).cast("string").alias("value"), mine)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, value string", CHANGE_STATE, "append", GroupStateTimeout.NoTimeout)


def in_flight(events: DataFrame, session: str = "session", order: str | list[str] = "seq") -> DataFrame:
    """``events`` with the jobs that run after each: starts and ends, never below zero; an end without a start counts for nothing."""
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "result", -1).otherwise(0)
    order = [order] if isinstance(order, str) else order
    rows = before(sliced(events, [session], order), [session], order, step, "_sum", "sum")
    rows = written(rows.withColumn("_sum", F.coalesce("_sum", F.lit(0)) + step), "in-flight")
    rows = before(rows, [session], order, F.col("_sum"), "_low", "min")
    # what was lost below zero so far
    lowest = F.least(F.coalesce("_low", F.lit(0)), F.col("_sum"), F.lit(0))
    return rows.withColumn("running", (F.col("_sum") - lowest).cast("long")).drop("_sum", "_low", "_slice", "_row")


def idle_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, busy: str | None = None) -> DataFrame:
    """(key, session, started, ended, n): runs of events with no pause of ``gap_seconds`` or more.

    ``busy`` names a column of jobs that run after an event; while one does, no pause ends a session.
    """
    rows = events.select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), (F.col(busy) if busy else F.lit(0)).cast("long").alias("_busy"))
    rows = before(sliced(rows, [key], ["_at"]), [key], ["_at"], F.struct("_at", "_row", "_busy"), "_last")
    long = (F.col("_at") - F.col("_last._at") >= gap_seconds * 1_000_000) & (F.col("_last._busy") <= 0)
    rows = written(rows.withColumn("_new", F.coalesce(long.cast("long"), F.lit(1))).drop("_last"), "idle")
    rows = before(rows, [key], ["_at"], F.col("_new"), "_n", "sum").withColumn("session", F.coalesce("_n", F.lit(0)) + F.col("_new"))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def idle_sessions_stream(events: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The same over a stream, by session windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")
