"""Rerankers: candidates in, the same candidates out with a score and an order. Model-backed ones take scores as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.vectors import cosine
from loomwork.functions.vectors import score as rounded
from loomwork.operators.lexical import bm25_candidates, by_maximum
from loomwork.operators.search import RRF_K, vector_pairs

#: Candidates that a task orders, about, where a query's own are fewer.
MOST_ORDERED = 1_000_000


def order_by_score(df: DataFrame, qid: str = "query_id", order: str = "ord") -> DataFrame:
    return df.withColumn(order, F.row_number().over(Window.partitionBy(qid).orderBy(F.col("score").desc(), order)))


def bm25(df: DataFrame, qid: str = "query_id", key: str = "doc_id", text: str = "content", query: str = "query") -> DataFrame:
    """BM25 over each query's candidates, divided by the best."""
    scored = bm25_candidates(df, qid, text, query).withColumn("score", rounded(F.col("bm25"))).drop("bm25")
    return order_by_score(by_maximum(scored, qid).withColumn("score", rounded(F.col("score"))), qid)


def rrf(df: DataFrame, qid: str = "query_id", key: str = "doc_id", text: str = "content", query: str = "query") -> DataFrame:
    """Incoming order and BM25 order fused, divided by the best."""
    scored = bm25_candidates(df, qid, text, query).withColumn("_b", rounded(F.col("bm25")))
    second = F.row_number().over(Window.partitionBy(qid).orderBy(F.col("_b").desc(), "ord"))
    fused = scored.withColumn("_r", second).withColumn("score", 1.0 / (RRF_K + F.col("ord")) + 1.0 / (RRF_K + F.col("_r"))).drop("bm25", "_b", "_r")
    return order_by_score(by_maximum(fused, qid).withColumn("score", rounded(F.col("score"))), qid)


def bi_encoder(df: DataFrame, qid: str = "query_id", query_vector: str = "query_embedding", vector: str = "embedding") -> DataFrame:
    return order_by_score(df.withColumn("score", rounded(cosine(F.col(query_vector), F.col(vector)))), qid)


def bi_encoder_alike(queries: DataFrame, corpus: DataFrame, on: str, qid: str = "query_id", key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """qid, key, score, ord: bi_encoder() where a query's candidates are all rows of the corpus that have its value of `on`, in the order of their keys.

    They grow with the square of the table. So scores are made where a row is, vectors aren't shuffled, keys and scores move once and
    packed, and the number of partitions follows from that of candidates, which is counted first.
    """
    sizes = corpus.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).join(queries.groupBy(on).agg(F.count(F.lit(1)).alias("_q")), on)
    n = sizes.agg(F.sum(F.col("_n") * F.col("_q"))).first()[0] or 0
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, math.ceil(n / MOST_ORDERED))
    packed = vector_pairs(queries, corpus, on, qid, key, vector).repartition(parts, qid)
    pairs = packed.select(qid, F.inline(F.arrays_zip("keys", "scores")).alias(key, "_s"))
    place = F.row_number().over(Window.partitionBy(qid).orderBy(F.col("_s").desc(), F.col(key).asc_nulls_last()))
    return pairs.select(qid, key, (F.col("_s") / 1e6).alias("score"), place.alias("ord"))


def cross_encoder(df: DataFrame, replies: DataFrame, qid: str = "query_id") -> DataFrame:
    """replies (qid, index, score): index is the 0-based place of the candidate. Candidates without a reply are dropped;
    a query without replies stays as it was."""
    known = replies.select(qid, (F.col("index") + 1).alias("ord"), F.col("score").alias("_s")).dropDuplicates([qid, "ord"])
    joined = df.join(known, [qid, "ord"], "left").withColumn("_any", F.max(F.col("_s").isNotNull()).over(Window.partitionBy(qid)))
    kept = joined.filter(F.col("_s").isNotNull() | ~F.col("_any")).withColumn("score", F.coalesce("_s", "score"))
    return order_by_score(kept.drop("_s", "_any"), qid)


def pointwise_score(grade: Column) -> Column:
    """A grade of 0 to 100 as a score; out of range is clamped, missing is 0."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(grade.cast("double"), F.lit(0.0)))) / 100.0


def pointwise(df: DataFrame, grade: str = "grade", qid: str = "query_id") -> DataFrame:
    return order_by_score(df.withColumn("score", pointwise_score(F.col(grade))), qid)


def listwise(df: DataFrame, permutations: DataFrame, qid: str = "query_id") -> DataFrame:
    """permutations (qid, permutation array<int> of 0-based places). Repeats and strangers are ignored, missing ones follow
    in their old order; the score falls linearly from 1."""
    n = Window.partitionBy(qid)
    named = permutations.select(qid, F.posexplode("permutation").alias("_pos", "_place"))
    first = named.groupBy(qid, (F.col("_place") + 1).alias("ord")).agg(F.min("_pos").alias("_pos"))
    joined = df.join(first, [qid, "ord"], "left").withColumn("_n", F.count(F.lit(1)).over(n))
    place = F.row_number().over(Window.partitionBy(qid).orderBy(F.col("_pos").asc_nulls_last(), "ord"))
    return joined.withColumn("_r", place).withColumn("score", (F.col("_n") - F.col("_r") + 1) / F.col("_n")).withColumn("ord", F.col("_r")).drop("_pos", "_n", "_r")


def cached(df: DataFrame, cache: DataFrame, rerank: Callable[[DataFrame], DataFrame], now: Column, strategy: str, qid: str = "query_id") -> DataFrame:
    """Cached scores where all of a query's candidates have a live one; other queries are reranked.

    cache (cache_key, score, expires_at); the key is strategy|query|SHA-256 of the content.
    """
    live = cache.filter(F.col("expires_at") > now).select("cache_key", F.col("score").alias("_s"))
    keyed = df.withColumn("cache_key", F.concat_ws("|", F.lit(strategy), F.col("query"), F.sha2("content", 256)))
    known = keyed.join(live, "cache_key", "left").withColumn("_all", F.min(F.col("_s").isNotNull()).over(Window.partitionBy(qid)))
    hits = order_by_score(known.filter("_all").withColumn("score", F.col("_s")), qid).select(*df.columns)
    return hits.unionByName(rerank(known.filter("NOT _all").select(*df.columns)).select(*df.columns))


RERANKERS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25, "rrf": rrf, "bi_encoder": bi_encoder, "cross_encoder": cross_encoder, "pointwise": pointwise, "listwise": listwise}
