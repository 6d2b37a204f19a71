"""Ingestion lifecycle on tables: first-seen filters, groups by identity, upserts, deletes, write batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITE_BATCH = 50
TOKEN_BUDGET = 7371  # 8191 tokens less a tenth


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def first_seen(chunks: DataFrame, seen: DataFrame | None = None, now: Column | None = None, order: tuple[str, ...] = ("identity", "chunk_index"), text: str = "content") -> DataFrame:
    """chunks whose content comes first in the given order and isn't among `seen` (hash, expires_at) that are still live."""
    # a content that very many chunks have, such as the blank one, is reduced before it is shuffled
    row = F.struct(*(F.col(f"`{c}`") for c in chunks.columns))
    first = chunks.groupBy(content_hash(F.col(text)).alias("_h")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    kept = first.select("_h", "_row.*")
    if seen is not None:
        live = seen if now is None else seen.filter(F.col("expires_at") > now)
        kept = kept.join(live.select(F.col("hash").alias("_h")), "_h", "left_anti")
    return kept.drop("_h")


def range_of(df: DataFrame, order: str, ranges: int) -> Column:
    """The range of values of `order`, from 0 on, that a row falls into; nulls are in range 0.

    The bounds are constants, from a sample of 32 rows for each range. A row's range follows from its value alone, so every
    plan that asks for it gets the same.
    """
    found = df.select(F.col(order).alias("v")).filter(F.col("v").isNotNull())
    sample = sorted(r["v"] for r in found.orderBy(F.rand(42)).limit(32 * ranges).collect())
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    if not bounds:
        return F.lit(0)
    block = max(1, int(len(bounds) ** 0.5))
    kind = df.schema[order].dataType
    constants = lambda values: F.array(*(F.lit(v).cast(kind) for v in values))
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col(order)))
    # whole blocks below the value first, then the bounds of the block it is in
    full = below(constants(bounds[block - 1 :: block])) if len(bounds) >= block else F.lit(0)
    inside = F.slice(constants(bounds), full * block + 1, F.lit(block))
    return F.coalesce(F.when(F.col(order).isNotNull(), full * block + below(inside)), F.lit(0))


def numbered(df: DataFrame, order: str, name: str = "row_no", ranges: int | None = None) -> DataFrame:
    """df with each row's place in order, from 0 on, nulls first. No task sees more than a range of the rows.

    Only the counts of the ranges are summed up, one row for each. Rows of equal order are numbered in no fixed order.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_range", range_of(df, order, ranges))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_in", within).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_range", "_in", "_before")


def anonymous(df: DataFrame, identity: str = "identity", order: str = "doc_id") -> DataFrame:
    """df with group_key. Only documents without an identity are numbered."""
    blank = F.trim(F.coalesce(F.col(identity), F.lit(""))) == ""
    named = df.filter(~blank).withColumn("group_key", F.col(identity))
    rest = numbered(df.filter(blank), order, "_anon")
    return named.unionByName(rest.withColumn("group_key", F.concat(F.lit("anon-"), F.col("_anon").cast("string"))).drop("_anon"))


def upsert(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """All of new's columns replace old ones by key; created_at stays where the key is known, updated_at becomes now."""
    columns = [c for c in new.columns if c not in (key, "created_at", "updated_at")]
    o = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns), F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"), F.lit(True).alias("_old"))
    n = new.select(key, *columns, F.lit(True).alias("_new"))
    j = o.join(n, key, "full_outer")
    is_new = F.coalesce("_new", F.lit(False))
    return j.select(
        key,
        *(F.when(is_new, F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in columns),
        F.when(F.col("_old").isNull(), now).otherwise(F.col("_created")).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("_updated")).alias("updated_at"),
    )


def incremental(store: DataFrame, chunks: DataFrame, identity: str = "identity", text: str = "content", changed_only: bool = False) -> DataFrame:
    """The store after an ingest: an identity with any content the store lacks is replaced by its current chunks (or, with
    changed_only, by the new ones alone); others stay."""
    known = store.select(content_hash(F.col(text)).alias("_h")).distinct()
    fresh = chunks.withColumn("_h", content_hash(F.col(text))).join(known, "_h", "left_anti")
    touched = fresh.select(identity).distinct()
    new = fresh.drop("_h") if changed_only else chunks.join(touched, identity, "left_semi")
    return store.join(touched, identity, "left_anti").unionByName(new.select(*store.columns))


def delete(store: DataFrame, identities: DataFrame, identity: str = "identity") -> DataFrame:
    return store.join(identities.select(identity).distinct(), identity, "left_anti")


def find(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_semi")


def write_batches(df: DataFrame, order: str, size: int = WRITE_BATCH) -> DataFrame:
    """df with batch_no: runs of `size` rows in order."""
    return numbered(df, order, "_row").withColumn("batch_no", F.floor(F.col("_row") / size).cast("long")).drop("_row")


def token_batches(df: DataFrame, tokens: str = "n_tokens", budget: int = TOKEN_BUDGET, by: str = "identity", order: str = "chunk_index") -> DataFrame:
    """df with batch_no within each group: batches are filled in order as long as the tokens fit; a larger row is a batch."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, n = object(), 0, 0
        for b in batches:
            out = []
            for g, t in zip(b.column(by).to_pylist(), b.column(tokens).to_pylist(), strict=True):
                if g != group:
                    group, used, n = g, 0, 0
                if used and used + (t or 0) > budget:
                    used, n = 0, n + 1
                used += t or 0
                out.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*names, "batch_no"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, f"{kinds}, batch_no bigint")


def once_per_text(df: DataFrame, text: str, make) -> DataFrame:
    """df with what make(DataFrame of _h and the text) adds: expensive work is done once for each distinct text."""
    hashed = df.withColumn("_h", content_hash(F.col(text)))
    distinct = hashed.groupBy("_h").agg(F.first(text).alias(text))
    return hashed.join(make(distinct).drop(text), "_h").drop("_h")
