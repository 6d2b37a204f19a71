"""Registered queries on events: limiters, breakers, rates, percentiles, time to live."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.plans.base import query, sql_round, table
from loomwork.streaming import stateful as S


def events(spark, d):
    return table(spark, d, "events")


FAILED = "event_type = 'error'"


def failed():
    return F.col("event_type") == "error"


@query("fixed_window_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n, n <= 2 AS allowed FROM events")
def fixed_window_limit(spark, d):
    return S.fixed_window_limit(events(spark, d), 2, "1 hour").select("event_id", "n", "allowed")


@query("sliding_failure_rate", f"""WITH w AS (SELECT event_id, CASE WHEN count(*) OVER x >= 10 THEN avg(({FAILED})::INTEGER) OVER x END AS r FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT event_id, {sql_round("r")} AS failure_rate, coalesce(r >= 0.5, FALSE) AS open FROM w""")  # fmt: skip
def sliding_failure_rate(spark, d):
    return S.sliding_failure_rate(events(spark, d), failed()).select("event_id", (F.floor(F.col("failure_rate") * 1e6 + 0.5) / 1e6).alias("failure_rate"), "open")


@query("ttl_sweep", "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def ttl_sweep(spark, d):
    e = events(spark, d).withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return S.live(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("request_rate", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, {sql_round('count(*) / 3600')} AS rate FROM events GROUP BY ALL")
def request_rate(spark, d):
    r = S.request_rate(events(spark, d), "1 hour")
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", (F.floor(F.col("rate") * 1e6 + 0.5) / 1e6).alias("rate"))


def sql_percentile(bounds) -> str:
    out = f"{float(bounds[-1])}"
    for i in reversed(range(len(bounds))):
        low, below = (float(bounds[i - 1]), f"b{i - 1}") if i else (0.0, "0")
        out = f"CASE WHEN b{i} >= n * 0.95 THEN {low} + CASE WHEN b{i} - {below} > 0 THEN (n * 0.95 - {below}) / (b{i} - {below}) * {bounds[i] - low} ELSE 0 END ELSE {out} END"
    return out


@query("latency_p95_buckets", f"""WITH g AS (SELECT date_trunc('day', ts) AS w, event_type, count(*) AS n, {", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(S.SLO_BUCKETS))} FROM events GROUP BY ALL)
    SELECT strftime(w, '%Y-%m-%d') AS window_start, event_type, n, {sql_round(sql_percentile(S.SLO_BUCKETS))} AS percentile FROM g""")  # fmt: skip
def latency_p95_buckets(spark, d):
    p = S.bucket_percentile(events(spark, d), width="1 day", by=("event_type",))
    return p.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", (F.floor(F.col("percentile") * 1e6 + 0.5) / 1e6).alias("percentile"))


@query("client_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'token:' || sha256('u' || user_id) WHEN event_id % 3 = 1 THEN 'ip:10.0.0.' || user_id ELSE 'ip:9.9.9.9' END AS key FROM events")
def client_key(spark, d):
    i, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    auth = F.when(i == 0, F.concat(F.lit("u"), u)).otherwise(" ")
    fwd = F.when(i == 1, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 1.1.1.1")))
    return events(spark, d).select("event_id", S.client_key(auth, fwd, F.lit("9.9.9.9")).alias("key"))


#: Events in the order in which a key's fold goes through them.
SQL_FOLD = f"e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, coalesce({FAILED}, FALSE) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query("token_bucket", f"""WITH RECURSIVE {SQL_FOLD}, r AS (SELECT user_id, rn, event_id, s, 1.0::DOUBLE AS held, TRUE AS allowed FROM e WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, s, CASE WHEN h >= 1 THEN h - 1 ELSE h END, h >= 1 FROM (SELECT e.*, least(2.0::DOUBLE, r.held + (e.s - r.s) * (1.0::DOUBLE / 240 / 60)) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
    SELECT event_id, allowed FROM r""")  # fmt: skip
def token_bucket(spark, d):
    return S.token_bucket(events(spark, d), capacity=2, per_minute=1 / 240).select("event_id", "allowed")


SQL_BREAKER = """CASE WHEN open AND s - opened < 86400 THEN 'rejected' WHEN NOT f THEN 'passed' ELSE 'failed' END"""


@query("circuit_breaker", f"""WITH RECURSIVE {SQL_FOLD}, r AS (SELECT user_id, rn, event_id, CASE WHEN f THEN 'failed' ELSE 'passed' END AS outcome, f::INTEGER AS failures, FALSE AS open, 0.0::DOUBLE AS opened FROM e WHERE rn = 1
    UNION ALL SELECT user_id, rn, event_id, o, CASE o WHEN 'rejected' THEN failures WHEN 'passed' THEN 0 ELSE failures + 1 END, CASE o WHEN 'rejected' THEN open WHEN 'passed' THEN FALSE ELSE failures + 1 >= 3 END,
        CASE WHEN o = 'failed' AND failures + 1 >= 3 THEN s WHEN o = 'rejected' THEN opened ELSE 0.0 END
        FROM (SELECT *, {SQL_BREAKER} AS o FROM (SELECT e.user_id, e.rn, e.event_id, e.s, e.f, r.failures, r.open, r.opened FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
    SELECT event_id, outcome FROM r""")  # fmt: skip
def circuit_breaker(spark, d):
    return S.circuit_breaker(events(spark, d), failed(), cooldown=86_400).select("event_id", "outcome")
