"""Content that has been seen: levelled, sorted runs of hashes with a time to live, which new chunks are anti-joined with.

A run is a Parquet table (hash, expires_at, batch) bucketed and sorted by hash, all runs alike, with Parquet's Bloom filters. Chunks are admitted
in batches: their hashes are dealt out like the runs and anti-joined with one run after the other by merge joins, so of the store no row
moves; a batch of few hashes reads, by Bloom filters and the order within the files, the pages that may hold them. The batch's new hashes are a
run of level 0. When a level holds fan_in runs they are merged, again in place, into one of the next level. A run whose last hash has expired
is dropped whole.

Runs are named by numbered manifests (commits.py): of two batches at once the second one is checked again against the first. With
batch=(application, number) a batch that is replayed gets the same answer as before, as its own hashes don't count against it.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.lifecycle import first_seen
from loomwork.sources.commits import Conflict, Manifests, applied_with, names_in, until_committed
from loomwork.sources.tables import MOST_ALONE, any_of, file_system, kept

TTL = timedelta(days=30)
FAN_IN = 4
#: Of the names that the catalogue has for the runs.
PREFIX = "loomwork_seen_"


class SeenStore:
    def __init__(self, spark: SparkSession, folder: str, ttl: timedelta = TTL, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.folder, self.ttl, self.fan_in = spark, folder.rstrip("/"), ttl, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.log = Manifests(spark, self.folder, keep=1)

    def state(self) -> tuple[int, dict]:
        n, found = self.log.last()
        return n, found or {"buckets": self.buckets, "levels": {}}

    def read(self, name: str, buckets: int) -> DataFrame:
        """A run; the catalogue of a new session doesn't know it yet, nor that it is bucketed."""
        place = f"{self.folder}/{name}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {PREFIX}{name} (hash BINARY, expires_at TIMESTAMP, batch STRING) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(f"{PREFIX}{name}")

    def write(self, df: DataFrame, buckets: int) -> str:
        name = f"run_{uuid.uuid4().hex}"
        out = df.select("hash", "expires_at", "batch").write.format("parquet").option("parquet.bloom.filter.enabled#hash", "true")
        out.bucketBy(buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}").saveAsTable(f"{PREFIX}{name}")
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {PREFIX}{name}")
        fs, p = file_system(self.spark, f"{self.folder}/{name}")
        fs.delete(p, True)

    def unseen(self, hashes: DataFrame, now: datetime, own: str | None = None, state: dict | None = None) -> DataFrame:
        """The rows of hashes (hash, ...) that no live run has; rows of the batch `own` don't count."""
        state = state or self.state()[1]
        some = [r[0] for r in hashes.select("hash").limit(MOST_ALONE + 1).collect()]
        few = len(some) <= MOST_ALONE
        out = hashes
        for run in (r for level in sorted(state["levels"]) for r in state["levels"][level] if r["newest"] > now.timestamp()):
            known = self.read(run["name"], state["buckets"]).filter((F.col("expires_at") > F.lit(now)) & ~F.col("batch").eqNullSafe(F.lit(own)) if own else F.col("expires_at") > F.lit(now))
            known = F.broadcast(known.filter(any_of("hash", some))) if few else known.hint("merge")
            out = out.join(known.select("hash"), "hash", "left_anti")
        return out

    def admit(self, chunks: DataFrame, now: datetime, batch: tuple[str, int] | None = None, order: tuple[str, ...] = ("identity", "chunk_index"), text: str = "content") -> DataFrame:
        """The chunks whose content comes first in order and hasn't been seen; from now on it has."""
        name = f"{batch[0]}:{batch[1]}" if batch else None
        hashed = kept(first_seen(chunks, order=order, text=text).withColumn("hash", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))), "chunks-hashed")

        def attempt() -> DataFrame:
            at, state = self.state()
            new = kept(self.unseen(hashed.repartition(state["buckets"], "hash"), now, name, state), "chunks-new")
            levels = {int(k): [r for r in v if r["newest"] > now.timestamp()] for k, v in state["levels"].items()}
            added = new.select("hash", F.lit(now + self.ttl).alias("expires_at"), F.lit(name).cast("string").alias("batch"))
            added = added if name is None else self.unseen(added, now, None, state)  # a replayed batch's hashes are there already
            made = [self.write(added, state["buckets"])]
            levels[0] = [*levels.get(0, []), {"name": made[0], "newest": (now + self.ttl).timestamp()}]
            self.compact(levels, now, state["buckets"], made)
            try:
                self.log.commit(at, state | {"levels": {str(k): v for k, v in levels.items() if v}, "applied": applied_with(state, batch)})
            except Conflict:
                for name_ in made:
                    self.drop(name_)
                raise
            named = {r["name"] for v in levels.values() for r in v}
            for gone in {*made, *(r["name"] for v in state["levels"].values() for r in v)} - named:
                self.drop(gone)
            return new.drop("hash")

        return until_committed(attempt)

    def compact(self, levels: dict[int, list[dict]], now: datetime, buckets: int, made: list[str]) -> None:
        """Merge full levels, two runs at a time, without moving a row; what has expired stays behind. Names of new runs go to made."""
        level = 0
        while len(levels.get(level, [])) >= self.fan_in:
            old, levels[level] = levels[level], []
            one = old[0]
            for other in old[1:]:
                a, b = self.read(one["name"], buckets), self.read(other["name"], buckets)
                theirs = b.select("hash", F.col("expires_at").alias("e"), F.col("batch").alias("b"))
                later = F.coalesce(F.col("e") > F.col("expires_at"), F.col("e").isNotNull())
                both = a.join(theirs.hint("merge"), "hash", "full").select("hash", F.when(later, F.col("e")).otherwise(F.col("expires_at")).alias("expires_at"), F.when(later, F.col("b")).otherwise(F.col("batch")).alias("batch"))
                merged = {"name": self.write(both.filter(F.col("expires_at") > F.lit(now)), buckets), "newest": max(one["newest"], other["newest"])}
                made.append(merged["name"])
                one = merged
            levels[level + 1] = [*levels.get(level + 1, []), one]
            level += 1

    def sweep(self) -> None:
        """Delete the runs of jobs that died before their commit; no other job may be at work."""
        named = {r["name"] for v in self.state()[1]["levels"].values() for r in v}
        for name in set(names_in(self.spark, self.folder, "run_")) - named:
            self.drop(name)
