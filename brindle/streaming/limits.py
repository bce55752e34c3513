"""Rate limits and caches with expiry: as replays of a log, and as stateful streams.

A window of the limit starts at a key's first hit and not by the clock, so the state is (start, count) per key. The
replay holds the state of one key at a time over sorted rows: memory does not grow with a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Stands for an event without a key.
NO_KEY = -(1 << 63)
DECISION = "event_id long, user_id long, hits long, allowed boolean"


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def count_hits(micros: np.ndarray, window: int, start: int | None = None, hits: int = 0) -> tuple[np.ndarray, int | None, int]:
    """The number of each hit (ascending times) within its window, and the state after the last one. One step per window."""
    out, at, n = np.empty(len(micros), np.int64), 0, len(micros)
    while at < n:
        if start is None or micros[at] - start >= window:
            start, hits = int(micros[at]), 0
        end = int(np.searchsorted(micros, start + window, "left"))
        out[at:end] = hits + 1 + np.arange(end - at)
        hits, at = hits + end - at, end
    return out, start, hits


def _rows(events: DataFrame, key: str, ts: str, event_id: str) -> DataFrame:
    return events.select(F.col(key).cast("long").alias("user_id"), F.col(event_id).cast("long").alias("event_id"), micros(ts).alias("t"))


def _counted(rows: DataFrame, window_s: int) -> DataFrame:
    """``rows`` (user_id, event_id, t) with hits: a fold over each partition's sorted rows."""
    wide = window_s * 1_000_000

    def run(batches):
        last, start, hits = None, None, 0
        for b in batches:
            key, t, out = b.column(0).fill_null(NO_KEY).to_numpy(), b.column(2).to_numpy(), np.empty(b.num_rows, np.int64)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if key[lo] != last:
                    last, start, hits = key[lo], None, 0
                out[lo:hi], start, hits = count_hits(t[lo:hi], wide, start, hits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], ["user_id", "event_id", "t", "hits"])

    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(run, "user_id long, event_id long, t long, hits long")


def rate_limit_replay(events: DataFrame, limit: int, window_s: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """event_id, user_id, hits (in its window so far), allowed: one decision per event."""
    return _counted(_rows(events, key, ts, event_id), window_s).select("event_id", "user_id", "hits", (F.col("hits") <= limit).alias("allowed"))


def rate_limit_stream(events: DataFrame, limit: int, window_s: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", late: str | None = None) -> DataFrame:
    """The same decisions over a stream; state per key: the window's start and its count.

    With ``late`` (how far events may come behind the newest, as an interval) a key's state goes once its window is over for
    good, and later events are dropped; without it no event is, and each key keeps its two numbers.
    """
    wide = window_s * 1_000_000

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, hits = state.get if state.exists else (None, 0)
        rows = pd.concat([p[["event_id", "t"]] for p in parts]).sort_values(["t", "event_id"])  # a key's rows of one trigger
        counted, start, hits = count_hits(rows["t"].to_numpy(), wide, start, hits)
        if start is not None:
            state.update((start, hits))
            if late:
                state.setTimeoutTimestamp(max((start + wide) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": k[0], "hits": counted, "allowed": counted <= limit})

    rows, timeout = _rows(events, key, ts, event_id), GroupStateTimeout.NoTimeout
    if late:
        seen = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
        rows = seen.select(F.col(key).cast("long").alias("user_id"), F.col(event_id).cast("long").alias("event_id"), micros(ts).alias("t"), F.col(ts).alias("seen"))
        timeout = GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(run, DECISION, "start long, hits long", "append", timeout)


def current_hits(events: DataFrame, at: str, window_s: int, key: str = "user_id", ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """user_id, hits: each key's count in the window that is open at the time ``at``; 0 where none is."""
    when = F.lit(at).cast("timestamp")
    replay = _counted(_rows(events.where(F.col(ts).cast("timestamp") <= when), key, ts, event_id), window_s)
    first, last = F.max(F.when(F.col("hits") == 1, F.col("t"))), F.max_by("hits", F.struct("t", "hits"))
    open_ = F.unix_micros(when) - first < window_s * 1_000_000
    return replay.groupBy("user_id").agg(F.when(open_, last).otherwise(F.lit(0)).cast("long").alias("hits"))


def cache_replay(ops: DataFrame, ttl_s: int, key: str = "key", ts: str = "ts", order: str = "event_id", is_put: str = "is_put", value: str = "value") -> DataFrame:
    """``ops`` with ``got``: what a get sees, the last put of its key that has not expired. Puts see nothing."""
    line = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    put = F.when(F.col(is_put), F.struct(F.col(ts).alias("at"), F.col(value).alias("v")))
    last = F.last(put, ignorenulls=True).over(line)
    alive = micros(ts) - micros(last["at"]) < ttl_s * 1_000_000
    return ops.withColumn("got", F.when(~F.col(is_put) & alive, last["v"]))


def cache_stream(ops: DataFrame, ttl_s: int, key: str = "user_id", ts: str = "ts", order: str = "event_id", is_put: str = "is_put", value: str = "value", late: str | None = None) -> DataFrame:
    """The same over a stream: event_id, got. State per key: its last put and when that was. With ``late`` (as for the rate
    limit) a key's state goes once its put has expired for good; a put that has expired is forgotten at the next operation."""
    wide = ttl_s * 1_000_000

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, held = state.get if state.exists else (None, None)
        rows, got = pd.concat([p[["event_id", "t", "put", "v"]] for p in parts]).sort_values(["t", "event_id"]), []
        for t, put, v in zip(rows["t"].tolist(), rows["put"].tolist(), rows["v"].tolist()):
            if put:
                at, held = t, v
            elif at is not None and t - at >= wide:
                at = held = None
            got.append(None if put or at is None else held)
        if at is None:
            if state.exists:
                state.remove()
        else:
            state.update((at, held))
            if late:
                state.setTimeoutTimestamp(max((at + wide) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "got": pd.Series(got, index=rows.index, dtype="float64")})

    seen = ops.withColumn(ts, F.col(ts).cast("timestamp"))
    columns = [F.col(key).cast("long").alias("user_id"), F.col(order).cast("long").alias("event_id"), micros(ts).alias("t"), F.col(is_put).alias("put"), F.col(value).cast("double").alias("v")]
    if late:
        seen, columns = seen.withWatermark(ts, late), [*columns, F.col(ts).alias("seen")]
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return seen.select(*columns).groupBy("user_id").applyInPandasWithState(run, "event_id long, got double", "at long, held double", "append", timeout)
