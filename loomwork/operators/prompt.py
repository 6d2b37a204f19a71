"""Contexts for answers: numbered citations, joined passages, chat windows, corpus listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import escape_fences

NO_CONTEXT = "No relevant context was found. Inform the user that you do not have enough information to answer their question."
NO_ANSWER = "I could not find relevant information in the documents to answer your question."
SEPARATOR = "\n\n---\n\n"


def citation_header(source: Column, file_name: Column, page: Column) -> Column:
    """[SOURCE: file, p.N], what is missing left out."""
    f = F.when(F.coalesce(file_name, F.lit("")) != "", F.concat(F.lit(": "), file_name)).otherwise(F.lit(""))
    p = F.when(page.isNotNull(), F.concat(F.lit(", p."), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.coalesce(source, F.lit("SOURCE")), f, p, F.lit("]"))


def joined(df: DataFrame, line: Column, separator: str, qid: str = "query_id", order: str = "rank") -> DataFrame:
    """qid, context: the lines of each query in order."""
    rows = df.select(qid, F.struct(F.col(order).alias("o"), line.alias("l")).alias("_r"))
    return rows.groupBy(qid).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["l"]), separator).alias("context"))


def contexts(queries: DataFrame, found: DataFrame, qid: str = "query_id", order: str = "rank") -> DataFrame:
    """qid, context: numbered, cited passages; a fixed message where nothing was found."""
    n = F.row_number().over(Window.partitionBy(qid).orderBy(order))
    numbered = found.withColumn("_n", n)
    head = citation_header(F.col("source"), F.col("file_name"), F.col("page"))
    line = F.concat(F.lit("Context "), F.col("_n").cast("string"), F.lit(":\n"), head, F.lit("\n"), escape_fences(F.coalesce("content", F.lit(""))), F.lit("\n\n"))
    made = joined(numbered, line, "", qid, "_n")
    return queries.select(qid).join(made, qid, "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def passages(queries: DataFrame, found: DataFrame, qid: str = "query_id", order: str = "rank") -> DataFrame:
    """qid, context: passages between separators; a canned answer where nothing was found."""
    made = joined(found, F.coalesce("content", F.lit("")), SEPARATOR, qid, order)
    return queries.select(qid).join(made, qid, "left").withColumn("context", F.coalesce("context", F.lit(NO_ANSWER)))


def chat_window(turns: DataFrame, last: int = 10, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last turns of each conversation."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last).drop("_n")


def listing(chunks: DataFrame, source: str = "source") -> DataFrame:
    """One row: distinct sources, sorted, and the number of chunks."""
    return chunks.agg(F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.count(F.lit(1)).alias("n_chunks"))


def extractive_answer(context: Column) -> Column:
    """A deterministic stand-in for generation: the first sentence of the context's first passage."""
    body = F.regexp_extract(context, r"(?s)\A(?:Context 1:\n\[[^\]]*\]\n)?(.*?[.!?])(?:\s|\z)", 1)
    return F.when(body == "", F.lit(NO_ANSWER)).otherwise(body)
