"""Caches that outlive a session: entries with a time to live, of which the least recently used leave.

A cache is a folder of Parquet tables named by numbered manifests (commits.py): the entries (key, values, put_at, expires_at, used_at) and logs of
later uses. A lookup appends the keys that it has hit to the log. A put folds the log into the entries, adds its own, drops what has expired, keeps the
`most` entries that were used last, and commits all of it as the next state; of two puts at once the second is made again on the
state of the first. Entries are bounded by `most`.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.lifecycle import content_hash
from loomwork.sources.commits import Conflict, Manifests, until_committed
from loomwork.sources.tables import file_system, kept

MOST = 5_000
TTL = timedelta(hours=24)


class StoredCache:
    """values is the schema of what an entry holds, such as "embedding array<double>"."""

    def __init__(self, spark: SparkSession, folder: str, values: str, most: int = MOST, ttl: timedelta = TTL):
        self.spark, self.folder, self.most, self.ttl = spark, folder.rstrip("/"), most, ttl
        self.shape = T.StructType.fromDDL(f"key string, {values}, put_at timestamp, expires_at timestamp, used_at timestamp")
        self.values = [f.name for f in T.StructType.fromDDL(values).fields]
        self.log = Manifests(spark, self.folder, keep=1)

    def _table(self, name: str, shape: T.StructType) -> DataFrame:
        return self.spark.read.schema(shape).parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _entries(self, state: dict | None) -> DataFrame:
        """The entries with the log of uses in used_at."""
        if not state:
            return self.spark.createDataFrame([], self.shape)
        held = self._table(state["entries"], self.shape)
        if not state["uses"]:
            return held
        paths = [f"{self.folder}/{n}" for n in state["uses"]]
        uses = self.spark.read.schema("key string, at timestamp").parquet(*paths).groupBy("key").agg(F.max("at").alias("_at"))
        return held.join(uses, "key", "left").withColumn("used_at", F.greatest("used_at", "_at")).drop("_at")

    def entries(self, now: datetime) -> DataFrame:
        return self._entries(self.log.last()[1]).filter(F.col("expires_at") > F.lit(now))

    def get(self, df: DataFrame, now: datetime, key: str = "key") -> DataFrame:
        """df with the values of live entries, null where there is none; the entries that are hit count as used."""
        live = self.entries(now).select(F.col("key").alias("_key"), *self.values)
        out = kept(df.join(F.broadcast(live), F.col(key) == F.col("_key"), "left"), "cache-lookup")
        used = out.filter("_key IS NOT NULL").select(F.col("_key").alias("key"), F.lit(now).alias("at")).distinct()
        if used.head(1):
            name = self._write(used, "uses")

            def log() -> None:
                at, state = self.log.last()
                self._commit(at, state | {"uses": [*state["uses"], name]})

            until_committed(log)
        return out.drop("_key")

    def put(self, new: DataFrame, now: datetime) -> None:
        """Add or replace entries (key and values, each key once)."""
        stamp = F.lit(now)
        rows = kept(new.select("key", *self.values), "cache-new").select("key", *self.values, stamp.alias("put_at"), F.lit(now + self.ttl).alias("expires_at"), stamp.alias("used_at"))

        def attempt() -> None:
            at, state = self.log.last()
            old = self._entries(state).filter(F.col("expires_at") > stamp).join(rows.select("key"), "key", "left_anti").select(*self.shape.names)
            every = old.unionByName(rows).orderBy(F.col("used_at").desc(), F.col("put_at").desc(), "key").limit(self.most)
            name = self._write(every, "entries")
            try:
                self._commit(at, {"entries": name, "uses": []})
            except Conflict:
                self._delete([name])
                raise

        until_committed(attempt)

    def _commit(self, at: int, state: dict) -> None:
        gone = self.log.commit(at, state)
        named = {state["entries"], *state["uses"]}
        self._delete([n for s in gone for n in (s["entries"], *s["uses"]) if n not in named])

    def _delete(self, names: list[str]) -> None:
        for n in names:
            fs, p = file_system(self.spark, f"{self.folder}/{n}")
            fs.delete(p, True)


def embed_through(texts: DataFrame, cache: StoredCache, now: datetime, make, text: str = "content") -> DataFrame:
    """texts with embedding: each distinct text that the cache doesn't have is embedded once, and is in the cache then.

    cache has the values "embedding array<double>"; make(df of hash and text) returns hash and embedding.
    """
    hashed = texts.withColumn("_hash", content_hash(F.col(text)))
    distinct = hashed.groupBy("_hash").agg(F.first(text).alias(text))
    found = cache.get(distinct, now, "_hash")
    made = kept(make(found.filter("embedding IS NULL").select(F.col("_hash").alias("hash"), text)).select(F.col("hash").alias("key"), "embedding"), "cache-made")
    cache.put(made, now)
    both = found.filter("embedding IS NOT NULL").select("_hash", "embedding").unionByName(made.select(F.col("key").alias("_hash"), "embedding"))
    return hashed.join(both, "_hash", "left").drop("_hash")


def rerank_through(candidates: DataFrame, rerank, strategy: str, cache: StoredCache, now: datetime, qid: str = "query_id", query: str = "query", text: str = "content", key: str = "doc_id") -> DataFrame:
    """qid, key, score, ord of a costly reranker behind a cache of its scores (values "score double").

    A query whose candidates all have a score in the cache is answered from it; all candidates of any other query are reranked and their
    scores are put into the cache. rerank(candidates) returns qid, key and score.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(strategy), F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))), 256)
    keyed = candidates.withColumn("_key", digest)
    # what is asked for is bounded by the candidates; a text that comes twice for a query is looked up once
    found = cache.get(keyed.select(qid, key, F.col("_key").alias("_cached")), now, "_cached")
    by = Window.partitionBy(qid)
    full = found.withColumn("_full", F.count("score").over(by) == F.count(F.lit(1)).over(by))
    hit = full.filter("_full").select(qid, key, "score")
    missed = keyed.join(full.filter(~F.col("_full")).select(qid).distinct(), qid, "left_semi")
    made = kept(rerank(missed.drop("_key")).select(qid, key, "score"), "rerank-made")
    cache.put(made.join(missed.select(qid, key, "_key"), [qid, key]).groupBy(F.col("_key").alias("key")).agg(F.max("score").alias("score")), now)
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), key)
    return hit.unionByName(made).withColumn("ord", F.row_number().over(w))
