"""What follows the first stage, in order: business rules, length band, near-duplicate filter, reranking, ranking, diversity, citations."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import tokens
from loomwork.functions.vectors import score as rounded
from loomwork.operators.chunking import bag_similarity, term_vector

#: Lower sorts first.
SOURCE_PRIORITY = {"PDF": 1, "DB": 2, "WIKI": 3}
TABLE_PRIORITY = {"release_notes": 1, "announcements": 2, "faqs": 3}
NEAR_DUPLICATE = 0.95
MMR_LAMBDA = 0.7


def day(c: Column) -> Column:
    """A date written as Jan 5, 2024 or 2024-01-05; null otherwise."""
    return F.coalesce(F.try_to_date(c, "MMM d, yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def visible(today: Column, source: str = "source", table: str = "table", visibility: str = "visibility", start: str = "effective_from", end: str = "effective_to") -> Column:
    """Database rows only: restricted FAQs are hidden, announcements outside their dates too; what can't be read as a date hides nothing."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    first, last = day(F.col(start)), F.when(blank(end), F.date_add(today, 1)).otherwise(day(F.col(end)))
    dated = F.when(blank(start), F.lit(True)).otherwise(F.coalesce((first <= today) & (today <= last), F.lit(True)))
    rule = F.when(F.col(table) == "faqs", F.upper(F.coalesce(F.col(visibility), F.lit(""))) != "RESTRICTED").when(F.col(table) == "announcements", dated).otherwise(F.lit(True))
    return F.when(F.coalesce(F.col(source), F.lit("")) == "DB", rule).otherwise(F.lit(True))


def business_rules(df: DataFrame, today: Column) -> DataFrame:
    return df.filter(visible(today))


def length_band(df: DataFrame, least: int = 0, most: int = 0, text: str = "content") -> DataFrame:
    """Chunks of least to most characters; 0 leaves a side open; null counts as empty."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    keep = F.lit(True)
    if least > 0:
        keep = keep & (n >= least)
    if most > 0:
        keep = keep & (n <= most)
    return df.filter(keep)


def by_group(df: DataFrame, qid: str, step) -> DataFrame:
    """step(rows of one query as pandas) -> rows. A query has at most the over-fetched number of candidates."""
    return df.groupBy(qid).applyInPandas(step, df.schema)


def near_duplicates(df: DataFrame, threshold: float = NEAR_DUPLICATE, qid: str = "query_id", text: str = "content", order: str = "ord") -> DataFrame:
    """Best first, a candidate stays if it is less similar than threshold to all that stayed. ord becomes the new order."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return rows
        rows = rows.sort_values([order]).sort_values(["score"], ascending=False, kind="stable")
        kept: list[dict] = []
        flags = []
        for t in rows[text].fillna(""):
            v = term_vector(t)
            flags.append(all(bag_similarity(v, k) < threshold for k in kept))
            if flags[-1]:
                kept.append(v)
        rows = rows[flags]
        return rows.assign(**{order: range(1, len(rows) + 1)})

    return by_group(df, qid, step)


def diversify(df: DataFrame, lam: float = MMR_LAMBDA, qid: str = "query_id", text: str = "content", order: str = "ord") -> DataFrame:
    """Maximal marginal relevance: next comes the largest lam * score - (1 - lam) * similarity to what is chosen; ord is the new order."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order]).reset_index(drop=True)
        if len(rows) < 3:
            return rows
        vectors = [term_vector(t) for t in rows[text].fillna("")]
        near, left, place = [0.0] * len(rows), list(range(len(rows))), {}
        while left:
            best = max(left, key=lambda i: (lam * rows["score"][i] - (1 - lam) * near[i], -i))
            left.remove(best)
            place[best] = len(place) + 1
            near = [max(n, bag_similarity(vectors[i], vectors[best])) if i in left else n for i, n in enumerate(near)]
        return rows.assign(**{order: [place[i] for i in range(len(rows))]})

    return by_group(df, qid, step)


def similarities(df: DataFrame, pairs: DataFrame, qid: str = "query_id", text: str = "content", order: str = "ord") -> DataFrame:
    """pairs (qid, left_ord, right_ord) with similarity: cosine of the token counts, 0 if either text has no token.

    Counts meet in a join by term that only pairs asked for take part in.
    """
    n = df.select(qid, order, F.explode(tokens(F.col(text))).alias("term")).groupBy(qid, order, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = n.groupBy(qid, order).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    side = lambda d, s: d.select(qid, F.col(order).alias(f"{s}_ord"), *(F.col(c).alias(f"_{s}_{c}") if c != "term" else F.col(c) for c in d.columns if c not in (qid, order)))
    dots = pairs.join(side(n, "left"), [qid, "left_ord"]).join(side(n, "right"), [qid, "right_ord", "term"]).groupBy(qid, "left_ord", "right_ord").agg(F.sum(F.col("_left_n") * F.col("_right_n")).alias("_dot"))
    out = pairs.join(dots, [qid, "left_ord", "right_ord"], "left").join(side(norm, "left"), [qid, "left_ord"], "left").join(side(norm, "right"), [qid, "right_ord"], "left")
    return out.select(qid, "left_ord", "right_ord", rounded(F.coalesce(F.col("_dot") / (F.col("_left_norm") * F.col("_right_norm")), F.lit(0.0))).alias("similarity"))


def priority(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(4)
    for name, p in table.items():
        out = F.when(c == name, p).otherwise(out)
    return out


def rank(df: DataFrame, qid: str = "query_id", order: str = "ord") -> DataFrame:
    """Score, then source, then (database rows) table and date, then the order so far."""
    db = F.col("source") == "DB"
    keys = [
        F.col("score").desc(),
        priority(F.col("source"), SOURCE_PRIORITY),
        F.when(db, priority(F.col("table"), TABLE_PRIORITY)).otherwise(0),
        F.when(db, day(F.col("date"))).desc_nulls_last(),
        F.col(order),
    ]
    return df.withColumn(order, F.row_number().over(Window.partitionBy(qid).orderBy(*keys)))


def rerank_head(df: DataFrame, rerank, top_n: int, least: float = 0.0, qid: str = "query_id", order: str = "ord") -> DataFrame:
    """Only the first top_n candidates get new scores (rerank: DataFrame -> DataFrame with score and ord); of these, scores
    below least go. The tail follows untouched. Queries with one candidate pass through."""
    n = F.count(F.lit(1)).over(Window.partitionBy(qid))
    counted = df.withColumn("_n", n)
    head, tail = counted.filter((F.col("_n") >= 2) & (F.col(order) <= top_n)).drop("_n"), counted.filter((F.col("_n") < 2) | (F.col(order) > top_n)).drop("_n")
    scored = rerank(head).select(*df.columns)
    if least > 0:
        scored = scored.filter(F.col("score") >= least)
    return scored.unionByName(tail)


def citations(df: DataFrame, qid: str = "query_id", keys: tuple[str, ...] = ("identity", "page", "chunk_index"), order: str = "ord") -> DataFrame:
    """The first row of each distinct citation, renumbered in order."""
    first = Window.partitionBy(qid, *keys).orderBy(order)
    kept = df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    return kept.withColumn("citation_no", F.row_number().over(Window.partitionBy(qid).orderBy(order)))


def page_of(page_number: Column, page: Column) -> Column:
    return F.coalesce(page_number, page).try_cast("int")


