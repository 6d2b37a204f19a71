"""Caches as tables: answers by similarity of their questions, embeddings by the hash of their text.

A cache is a DataFrame; put, sweep and lookups return DataFrames, and whoever keeps the table writes it. Entries leave in
the order in which they came once there are more than the limit, and when their time is over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import is_blank
from loomwork.operators.lifecycle import content_hash
from loomwork.sources.tables import kept as keep

MOST_ANSWERS = 500
ANSWER_TTL = "30 minutes"
MOST_EMBEDDINGS = 5_000
EMBEDDING_TTL = "24 hours"


def last_in(cache: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """The `most` entries that came last. The cache and what is put in at a time are small: they are ranked in one task."""
    return cache.orderBy(F.col(seq).desc()).limit(most)


def sweep(cache: DataFrame, now: Column) -> DataFrame:
    """The entries whose time isn't over."""
    return cache.filter(F.col("expires_at") > now)


def put_answers(cache: DataFrame, new: DataFrame, now: Column, ttl: str = ANSWER_TTL, most: int = MOST_ANSWERS) -> DataFrame:
    """The cache (seq, embedding, answer, expires_at) after new (embedding, answer, ord), in the order ord; blank answers
    aren't kept. The oldest leave where there are too many."""
    start = cache.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_start"))
    kept = new.filter(~is_blank(F.col("answer")))
    # only the last `most` can stay, so no more are numbered
    ranked = kept.orderBy(F.col("ord").desc()).limit(most).withColumn("_n", F.row_number().over(Window.orderBy("ord")))
    added = ranked.crossJoin(F.broadcast(start)).select((F.col("_start") + F.col("_n")).cast("long").alias("seq"), "embedding", "answer", (now + F.expr(f"INTERVAL {ttl}")).alias("expires_at"))
    return last_in(cache.select("seq", "embedding", "answer", "expires_at").unionByName(added), most)


def embed_cached(texts: DataFrame, cache: DataFrame, now: Column, make, text: str = "content", ttl: str = EMBEDDING_TTL, most: int = MOST_EMBEDDINGS) -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, the cache after it): each distinct text without a live entry is embedded once.

    cache (hash, embedding, seq, expires_at); make(df of hash and text) returns hash and embedding.
    """
    hashed = texts.withColumn("hash", content_hash(F.col(text)))
    live = sweep(cache, now).select("hash", "embedding")
    missing = hashed.groupBy("hash").agg(F.first(text).alias(text)).join(live, "hash", "left_anti")
    made = keep(make(missing).select("hash", "embedding"), "embeddings-made")  # both results use it
    found = hashed.join(live.unionByName(made), "hash", "left").drop("hash")
    start = cache.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_start"))
    ranked = made.orderBy(F.col("hash").desc()).limit(most).withColumn("_n", F.row_number().over(Window.orderBy("hash")))
    added = ranked.crossJoin(F.broadcast(start)).select("hash", "embedding", (F.col("_start") + F.col("_n")).cast("long").alias("seq"), (now + F.expr(f"INTERVAL {ttl}")).alias("expires_at"))
    kept = cache.join(made.select("hash"), "hash", "left_anti").select("hash", "embedding", "seq", "expires_at")
    return found, last_in(kept.unionByName(added), most)


def stamped(chunks: DataFrame, vectors: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """chunks with embedding, embedding_model and embedding_dimension, so that one table holds records and vectors.

    A chunk without a vector has a null embedding of dimension 0.
    """
    out = chunks.join(vectors.select(key, "embedding"), key, "left")
    return out.withColumn("embedding_model", F.lit(model)).withColumn("embedding_dimension", F.coalesce(F.size("embedding"), F.lit(0)).cast("int"))
