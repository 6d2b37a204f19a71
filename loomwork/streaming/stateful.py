"""Time-driven operators over events: limiters, breakers, rates and percentiles; in batch, and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY, PER_MINUTE = 120, 120
WINDOW_LIMIT = 20
BREAKER_FAILURES, BREAKER_COOLDOWN_S = 3, 30
#: Upper bounds of latency buckets, in ms. Fixed values.
SLO_BUCKETS = (50, 100, 200, 300, 500, 1000, 2000, 5000)


def client_key(authorization: Column, forwarded: Column, remote: Column) -> Column:
    """token:hash of the authorization, else ip: of the first forwarded or the remote address."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ip = F.when(blank(forwarded), remote).otherwise(F.trim(F.split(forwarded, ",")[0]))
    return F.when(~blank(authorization), F.concat(F.lit("token:"), F.sha2(authorization, 256))).otherwise(F.concat(F.lit("ip:"), ip))


def fold_by_key(df: DataFrame, key: str, order: list[str], columns: list[str], start, step, out: str, kind: str) -> DataFrame:
    """df with `out`: a fold over each key's rows in order. start() makes a state, step(state, *values) -> (state, result).

    Rows stream by in sorted Arrow batches with one state at a time, so a key's rows need not fit in memory.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in batches:
            results = []
            for k, *values in zip(*(b.column(c).to_pylist() for c in [key, *columns]), strict=True):
                if k != last:
                    last, state = k, start()
                state, r = step(state, *values)
                results.append(r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results)], [*names, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{kinds}, {out} {kind}")


def take_token(state: tuple[float, float | None], now: float, capacity: float, per_second: float) -> tuple[tuple[float, float], bool]:
    """A bucket that refills all the time: (tokens, time of the last look) and whether one could be taken."""
    held, then = state
    held = min(capacity, held + (now - (now if then is None else then)) * per_second)
    return ((held - 1.0, now), True) if held >= 1.0 else ((held, now), False)


def token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", capacity: float = CAPACITY, per_minute: float = PER_MINUTE) -> DataFrame:
    """events with allowed, one bucket a key."""
    timed = events.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    step = lambda s, now: take_token(s, now, capacity, per_minute / 60.0)
    return fold_by_key(timed, key, [ts, tie], ["_s"], lambda: (capacity, None), step, "allowed", "boolean").drop("_s")


def breaker_step(state: tuple[str, int, float], now: float, failed: bool, most: int, cooldown: float) -> tuple[tuple[str, int, float], str]:
    """One call through a breaker: (mode, failures in a row, time it opened) and what became of the call.

    Calls come one after the other, so the call that finds the cooldown over is the probe, and its outcome is known at once.
    """
    mode, failures, opened = state
    if mode == "OPEN" and now - opened < cooldown:
        return state, "rejected"
    if not failed:
        return ("CLOSED", 0, 0.0), "passed"
    failures += 1
    return (("OPEN", failures, now) if failures >= most else ("CLOSED", failures, 0.0)), "failed"


def circuit_breaker(events: DataFrame, failed: Column, key: str = "user_id", ts: str = "ts", tie: str = "event_id", most: int = BREAKER_FAILURES, cooldown: float = BREAKER_COOLDOWN_S) -> DataFrame:
    """events with outcome: passed, failed or rejected, one breaker a key."""
    timed = events.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).withColumn("_f", failed)
    step = lambda s, now, f: breaker_step(s, now, bool(f), max(1, most), cooldown)
    return fold_by_key(timed, key, [ts, tie], ["_s", "_f"], lambda: ("CLOSED", 0, 0.0), step, "outcome", "string").drop("_s", "_f")


def fixed_window_limit(events: DataFrame, limit: int = WINDOW_LIMIT, width: str = "1 minute", key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with window_start, n (place within the key's window) and allowed."""
    w = events.withColumn("window_start", F.window(ts, width)["start"])
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    return w.withColumn("n", n).withColumn("allowed", F.col("n") <= limit)


def sliding_failure_rate(events: DataFrame, failed: Column, calls: int = 10, threshold: float = 0.5, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with failure_rate over the last `calls` calls of the key and open; null and closed until there are so many."""
    w = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(1 - calls, 0)
    rate = F.when(F.count(F.lit(1)).over(w) >= calls, F.avg(failed.cast("double")).over(w))
    return events.withColumn("failure_rate", rate).withColumn("open", F.coalesce(F.col("failure_rate") >= threshold, F.lit(False)))


def request_rate(events: DataFrame, width: str = "1 minute", by: tuple[str, ...] = ("event_type",), ts: str = "ts") -> DataFrame:
    """Requests per second in each window."""
    n = events.groupBy(F.window(ts, width)["start"].alias("window_start"), *by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rate", F.col("n") / seconds(width))


def seconds(width: str) -> float:
    n, unit = width.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def bucket_percentile(events: DataFrame, p: float = 0.95, value: str = "value", width: str = "5 minutes", slide: str | None = None, by: tuple[str, ...] = (), ts: str = "ts", bounds: tuple[int, ...] = SLO_BUCKETS) -> DataFrame:
    """window_start, by, n, percentile estimated from cumulative buckets with linear interpolation; what lies beyond the last bound counts as it."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = [F.sum((F.col(value) <= b).cast("int")).alias(f"_b{i}") for i, b in enumerate(bounds)]
    g = events.groupBy(win["start"].alias("window_start"), *by).agg(F.count(F.lit(1)).alias("n"), *counts)
    want = F.col("n") * p
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, below = (float(bounds[i - 1]), F.col(f"_b{i - 1}")) if i else (0.0, F.lit(0))
        here = F.col(f"_b{i}") - below
        inside = F.lit(low) + F.when(here > 0, (want - below) / here * (bounds[i] - low)).otherwise(F.lit(0.0))
        out = F.when(F.col(f"_b{i}") >= want, inside).otherwise(out)
    return g.withColumn("percentile", out).select("window_start", *by, "n", "percentile")


def live(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires) > now)


# --- streams


def stream_first_seen(chunks: DataFrame, ttl: str = "30 days", ts: str = "ts", text: str = "content") -> DataFrame:
    """First occurrence of each content within the time to live; state is dropped behind the watermark."""
    return chunks.withColumn("hash", F.sha2(F.coalesce(text, F.lit("")), 256)).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["hash"])


def stream_window_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", by: tuple[str, ...] = ("user_id",), ts: str = "ts") -> DataFrame:
    """Counts by window and key, final once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def stream_token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts", capacity: float = CAPACITY, per_minute: float = PER_MINUTE, idle_ms: int = 3_600_000) -> DataFrame:
    """key, event_id, allowed for a stream: the bucket is the key's state and goes after an idle hour."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held, then = state.get if state.exists else (capacity, -1.0)
        bucket = (held, None if then < 0 else then)
        rows = pd.concat(list(parts)).sort_values([ts, "event_id"])
        out = []
        for e, t in zip(rows["event_id"], rows[ts], strict=True):
            bucket, ok = take_token(bucket, max(t.timestamp(), bucket[1] or 0.0), capacity, per_minute / 60.0)
            out.append((k[0], e, ok))
        state.update(bucket)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, "event_id", "allowed"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_inbox(spark, path: str, archive: str, schema: str, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """Files dropped into a folder, each read once; read files are moved to the archive by the source itself."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).option("cleanSource", "archive").option("sourceArchiveDir", archive).load(path)


def watch_inbox(stream: DataFrame, handle, checkpoint: str, every: str = "30 seconds", once: bool = False):
    """Hand each batch to handle(df, batch_id); the checkpoint makes a batch run again only if it failed."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
