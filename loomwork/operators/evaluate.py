"""Retrieval metrics from ranked relevance rows (query_id, rank, rel), and reports built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), qid: str = "query_id") -> DataFrame:
    """qid and, for each k, precision, recall, hit rate and nDCG; reciprocal rank and context precision over all ranks.

    ranked has rel (boolean) by rank from 1; totals has (qid, total): how many relevant there are. A query of totals without
    results scores 0. Precision divides by the ranks there are if fewer than k; nDCG's ideal uses the relevant that were
    retrieved; recall is at most 1.
    """
    rel = F.col("rel").cast("int")
    before = F.sum(rel).over(Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    seen = ranked.withColumn("_before", before)
    per = []
    for k in ks:
        inside = F.col("rank") <= k
        per += [
            F.sum(F.when(inside, rel).otherwise(0)).alias(f"_hits_{k}"),
            F.sum(inside.cast("int")).alias(f"_n_{k}"),
            F.sum(F.when(inside, rel / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))).alias(f"_dcg_{k}"),
        ]
    grouped = seen.groupBy(qid).agg(F.min(F.when(F.col("rel"), F.col("rank"))).alias("_first"), F.sum(rel).alias("_found"), F.sum(rel * F.col("_before") / F.col("rank")).alias("_ap"), *per)
    joined = totals.select(qid, "total").join(grouped, qid, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.col(qid)]
    for k in ks:
        hits, n = F.coalesce(F.col(f"_hits_{k}"), F.lit(0)), F.col(f"_n_{k}")
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("_found"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1)))
        out += [
            zero(hits / n).alias(f"precision_{k}"),
            zero(F.when(F.col("total") > 0, F.least(F.lit(1.0), hits / F.col("total")))).alias(f"recall_{k}"),
            zero((hits > 0).cast("double")).alias(f"hit_{k}"),
            zero(F.when(F.col("_found") > 0, F.col(f"_dcg_{k}") / ideal)).alias(f"ndcg_{k}"),
        ]
    out += [zero(1.0 / F.col("_first")).alias("reciprocal_rank"), zero(F.when(F.col("total") > 0, F.col("_ap") / F.col("total"))).alias("context_precision")]
    return joined.select(*out)


def means(per_query: DataFrame, qid: str = "query_id") -> DataFrame:
    """One row: the mean of each metric, 0 without queries."""
    return per_query.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in per_query.columns if c != qid))


def matched_label(labels: Column, *names: Column) -> Column:
    """The first label contained in the lower-cased names of a chunk; null if none is."""
    where = F.lower(F.concat_ws("|", *names))
    return F.get(F.filter(labels, lambda x: F.contains(where, F.lower(x))), F.lit(0))


def label_recall(found: DataFrame, qrels: DataFrame, k: int, qid: str = "query_id") -> DataFrame:
    """qid, label_recall: distinct labels met in the first k chunks over labels expected."""
    met = found.filter((F.col("rank") <= k) & F.col("label").isNotNull()).groupBy(qid).agg(F.countDistinct("label").alias("_met"))
    want = F.size(F.array_distinct("relevant_sources"))
    return qrels.join(met, qid, "left").select(qid, F.when(want > 0, F.least(F.lit(1.0), F.coalesce("_met", F.lit(0)) / want)).otherwise(F.lit(0.0)).alias("label_recall"))


def context_sources(found: DataFrame, qid: str = "query_id") -> DataFrame:
    """qid, context_sources: distinct 'source: file' of a generation report, sorted."""
    name = F.when(F.coalesce("file_name", F.lit("")) == "", F.col("source")).otherwise(F.concat_ws(": ", "source", "file_name"))
    return found.groupBy(qid).agg(F.sort_array(F.collect_set(name)).alias("context_sources"))


def sufficient(context: Column, judged: Column) -> Column:
    """A judge's verdict: a blank context never suffices, a failed judge counts as yes."""
    return F.when(F.coalesce(F.trim(context), F.lit("")) == "", F.lit(False)).otherwise(F.coalesce(judged, F.lit(True)))


def overlap_judge(answer: Column, context: Column, least: float = 0.5) -> Column:
    """A deterministic faithfulness judge: enough of the answer's distinct terms are in the context."""
    from loomwork.functions.text import tokens

    a, c = F.array_distinct(tokens(answer)), tokens(context)
    return F.when(F.size(a) == 0, F.lit(True)).otherwise(F.size(F.array_intersect(a, c)) / F.size(a) >= least)
