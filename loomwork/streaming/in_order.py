"""Folds over each key's events in the order of their time, as streams that give what the batch operators give.

Micro-batches bring events late and out of order. An event waits in its key's state until the watermark has passed it, which a timer of event time
tells; what waits is then folded in order of (time, event id), as stateful.py does over a whole table. So a stream's rows are those of
the batch query however its events were cut into micro-batches, but for events that come later than `late`, which Spark drops, and those
that no watermark has passed yet.

State is kept by RocksDB, which use_rocksdb() chooses. What a key holds is bounded by its events within `late`. A state that an idle key no longer
needs (a bucket that is full again, a window that is over) is dropped by a timer too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomwork.streaming.stateful import BREAKER_COOLDOWN_S, BREAKER_FAILURES, CAPACITY, PER_MINUTE, WINDOW_LIMIT, breaker_step, seconds, take_token

LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB; those with a checkpoint keep what they have."""
    spark.conf.set(PROVIDER, ROCKSDB)


class FoldInOrder(StatefulProcessor):
    """step(state, seconds, flag) -> (state, result) over a key's events; state is a tuple of state_schema."""

    def __init__(self, start: tuple, step: Callable, state_schema: str, names: list[str], idle_us: int | None):
        self.start, self.step, self.state_schema, self.names, self.idle_us = start, step, state_schema, names, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id bigint, at bigint, flag boolean")
        self.state = handle.getValueState("state", self.state_schema)

    def wake(self, at_us: int) -> None:
        """One timer a key, at the earliest event that waits."""
        at = at_us // 1000 + 1
        known = list(self.handle.listTimers())
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(e), int(t), bool(f)) for df in rows for e, t, f in zip(df["event_id"], df["at_us"], df["flag"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.wake(min(t for _, t, _ in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        ready = [r for r in rows if r[1] <= passed]
        rest = rows[len(ready) :]
        state = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for event, at, flag in ready:
            state, result = self.step(state, at / 1e6, flag)
            out.append((key[0], event, result))
        if ready:
            self.state.update(state)
        elif not rest and self.idle_us is not None:
            self.state.clear()
        if rest:
            self.waiting.put(rest)
            self.wake(rest[0][1])
        else:
            self.waiting.clear()
            if ready and self.idle_us is not None:
                self.wake(ready[-1][1] + self.idle_us)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def fold_in_order(events: DataFrame, start: tuple, step: Callable, state_schema: str, out: str, kind: str, flag: Column | None = None, key: str = "user_id", ts: str = "ts", tie: str = "event_id", late: str = LATE, idle_s: float | None = None) -> DataFrame:
    """key, event_id and `out` of a stream of events."""
    rows = events.withWatermark(ts, late).select(key, F.col(tie).cast("long").alias("event_id"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), (F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False)).alias("flag"))
    made = FoldInOrder(start, step, state_schema, [key, "event_id", out], None if idle_s is None else int(idle_s * 1e6))
    shape = f"`{key}` {events.schema[key].dataType.simpleString()}, event_id bigint, `{out}` {kind}"
    return rows.groupBy(key).transformWithStateInPandas(made, shape, "Append", "EventTime")


def token_bucket(events: DataFrame, capacity: float = CAPACITY, per_minute: float = PER_MINUTE, **how) -> DataFrame:
    """key, event_id, allowed; an idle key's bucket goes when it is full again."""

    def step(state: tuple, now: float, _: bool) -> tuple[tuple, bool]:
        held, then = state
        (held, then), ok = take_token((held, None if then < 0 else then), now, capacity, per_minute / 60.0)
        return (held, then), ok

    return fold_in_order(events, (float(capacity), -1.0), step, "held double, at double", "allowed", "boolean", idle_s=60.0 * capacity / per_minute + 1, **how)


def fixed_window_limit(events: DataFrame, limit: int = WINDOW_LIMIT, width: str = "1 minute", **how) -> DataFrame:
    """key, event_id, allowed: the first `limit` events of each window."""
    size = int(seconds(width))

    def step(state: tuple, now: float, _: bool) -> tuple[tuple, bool]:
        window = int(now // size)
        n = state[1] + 1 if state[0] == window else 1
        return (window, n), n <= limit

    return fold_in_order(events, (-1, 0), step, "window bigint, n bigint", "allowed", "boolean", idle_s=size, **how)


def circuit_breaker(events: DataFrame, failed: Column, most: int = BREAKER_FAILURES, cooldown: float = BREAKER_COOLDOWN_S, **how) -> DataFrame:
    """key, event_id, outcome: passed, failed or rejected."""
    step = lambda s, now, f: breaker_step(s, now, f, max(1, most), cooldown)
    return fold_in_order(events, ("CLOSED", 0, 0.0), step, "mode string, failures bigint, opened double", "outcome", "string", flag=failed, **how)


def sliding_failure_rate(events: DataFrame, failed: Column, calls: int = 10, threshold: float = 0.5, **how) -> DataFrame:
    """key, event_id, open: whether at least `threshold` of the key's last `calls` calls failed; closed until there are so many."""

    def step(state: tuple, now: float, f: bool) -> tuple[tuple, bool]:
        last = (state[0] + ("1" if f else "0"))[-calls:]
        return (last,), len(last) == calls and last.count("1") / calls >= threshold

    return fold_in_order(events, ("",), step, "last string", "open", "boolean", flag=failed, **how)


class SeenOnce(StatefulProcessor):
    """The first row of each key; what a key holds goes after the time to live."""

    def __init__(self, ttl_ms: int, columns: list[str]):
        self.ttl_ms, self.columns = ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            if first is None and len(df):
                first = df.iloc[:1]
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first[self.columns]

    def close(self) -> None:
        pass


def first_seen(chunks: DataFrame, ttl_s: float = 30 * 86_400, text: str = "content") -> DataFrame:
    """One chunk of each content, until ttl_s of processing time have gone by since; state variables have that time to live."""
    keyed = chunks.withColumn("hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    shape = ", ".join(f"`{c}` {t}" for c, t in keyed.dtypes)
    return keyed.groupBy("hash").transformWithStateInPandas(SeenOnce(int(ttl_s * 1000), keyed.columns), shape, "Append", "ProcessingTime")
