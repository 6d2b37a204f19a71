"""What runs around a job on the driver: retries, commands, background jobs with a status, meters."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def with_retry[T](action: Callable[[], T], attempts: int = 3, base_s: float = 0.2, sleep: Callable[[float], None] = time.sleep, name: str = "action") -> T:
    """action's result; after a failure it is tried again, at most `attempts` times in all, with pauses that double from base_s.

    Spark repeats failed tasks by itself; this is for what the driver does, such as a commit to a store.
    """
    for n in range(1, max(1, attempts) + 1):
        try:
            return action()
        except Exception as e:
            if n >= attempts:
                raise
            log.warning("%s failed (%d of %d): %s", name, n, attempts, e)
            sleep(base_s * 2 ** (n - 1))
    raise AssertionError


def execute[T](name: str, action: Callable[[], T], meter: Meter | None = None) -> T:
    """Run a command: its name, its time and its end are logged, and metered if there is a meter."""
    start = time.monotonic()
    log.info("%s started", name)
    try:
        out = action()
    except Exception:
        log.exception("%s failed after %.1f s", name, time.monotonic() - start)
        raise
    finally:
        if meter:
            meter.add(f"{name}.seconds", time.monotonic() - start)
    log.info("%s done in %.1f s", name, time.monotonic() - start)
    return out


class Meter:
    """Named numbers: counters and times that add up, gauges that are replaced; and what Spark observes while a plan runs."""

    def __init__(self):
        self.values: dict[str, float] = {}
        self.observed: list[tuple[str, Observation]] = []
        self._lock = threading.Lock()

    def add(self, name: str, value: float = 1.0) -> None:
        with self._lock:
            self.values[name] = self.values.get(name, 0.0) + value

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self.values[name] = float(value)

    def gauges(self, prefix: str, report: DataFrame) -> None:
        """The numbers of a one-row report as gauges, such as the means of an evaluation."""
        row = report.first()
        for k, v in (row.asDict() if row else {}).items():
            if isinstance(v, (int, float)):
                self.gauge(f"{prefix}.{k}", v)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        start = time.monotonic()
        try:
            yield
        except Exception:
            self.add(f"{name}.failures")
            raise
        finally:
            self.add(f"{name}.count")
            self.add(f"{name}.seconds", time.monotonic() - start)

    def watch(self, df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
        """df, of which Spark counts rows and any other aggregates on the way, without a pass of its own."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        with self._lock:
            self.observed.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in aggregates.items()))

    def collect(self) -> dict[str, float]:
        """All values; plans that were watched must have run."""
        with self._lock:
            waiting, self.observed = self.observed, []
        for name, seen in waiting:
            for k, v in seen.get.items():
                self.add(f"{name}.{k}", float(v or 0))
        return dict(self.values)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.collect().items()), "name string, value double")


def metered(method: Callable[..., DataFrame], meter: Meter, name: str = "rag.rerank") -> Callable[..., DataFrame]:
    """A reranker whose plans are timed when built, counted when they fail, and whose rows and scores are observed."""

    def run(candidates: DataFrame, **options) -> DataFrame:
        with meter.timed(name):
            out = method(candidates, **options)
        return meter.watch(out, name, score_sum=F.sum("score"), score_max=F.max("score"))

    return run


@dataclass(frozen=True)
class Job:
    job_id: str
    file_name: str
    status: str = "PENDING"  # then RUNNING, then DONE or FAILED
    error: str | None = None


class Jobs:
    """Uploads that are ingested in the background, a few at a time, and their states."""

    def __init__(self, workers: int = 2):
        self._pool = ThreadPoolExecutor(workers)
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()

    def _set(self, job: Job) -> None:
        with self._lock:
            self._jobs[job.job_id] = job

    def submit(self, file_name: str | None, action: Callable[[], object]) -> str:
        """Start action and return the id of its job at once."""
        job = Job(uuid.uuid4().hex, file_name or "upload")
        self._set(job)

        def run() -> None:
            self._set(replace(job, status="RUNNING"))
            try:
                action()
            except Exception as e:
                self._set(replace(job, status="FAILED", error=str(e)))
            else:
                self._set(replace(job, status="DONE"))

        self._pool.submit(run)
        return job.job_id

    def get(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def table(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = [(j.job_id, j.file_name, j.status, j.error) for j in self._jobs.values()]
        return spark.createDataFrame(rows, "job_id string, file_name string, status string, error string")

    def close(self) -> None:
        """Wait for all jobs."""
        self._pool.shutdown()
