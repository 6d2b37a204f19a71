"""Query variants: one query becomes one or more rows (query_id, variant_no, query). Models plug in as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import is_blank, strip

MODES = ("NONE", "REWRITE", "MULTI_QUERY", "HYDE", "STEP_BACK")


def replaced(query: Column, made: Column) -> Column:
    """A model's text instead of the query; the query where the model gave nothing."""
    return F.when(is_blank(made), query).otherwise(strip(made))


def multi(query: Column, variants: Column) -> Column:
    """The original first, then the variants that are not blank and not yet there."""
    kept = F.filter(F.transform(F.coalesce(variants, F.array().cast("array<string>")), strip), lambda v: v != "")
    return F.array_distinct(F.concat(F.array(query), kept))


def transform(queries: DataFrame, mode: str = "NONE", made: Column | None = None, qid: str = "query_id", text: str = "query") -> DataFrame:
    """qid, variant_no, query. Unknown modes, and modes without a model, leave the query as it is."""
    q = F.col(text)
    if mode == "MULTI_QUERY" and made is not None:
        variants = multi(q, made)
    elif mode in ("REWRITE", "HYDE", "STEP_BACK") and made is not None:
        variants = F.array(replaced(q, made))
    else:
        variants = F.array(q)
    return queries.select(qid, F.posexplode(variants).alias("variant_no", "query"))


def chosen(mode: Column, transform_: Column, default_mode: str = "HYBRID", default_transform: str = "NONE") -> tuple[Column, Column]:
    """A classifier's pair of choices; if one is missing both defaults hold."""
    missing = mode.isNull() | transform_.isNull()
    return F.when(missing, F.lit(default_mode)).otherwise(mode), F.when(missing, F.lit(default_transform)).otherwise(transform_)


def classify(query: Column) -> tuple[Column, Column]:
    """A deterministic classifier: codes ask for keywords, long questions for several variants, short ones for both sides."""
    code = query.rlike(r"\b[A-Z]+-?\d{2,}\b")
    words = F.size(F.split(query, r"\s+"))
    mode = F.when(code, "KEYWORD").when(words > 12, "VECTOR").otherwise("HYBRID")
    return mode, F.when(code, "NONE").when(words > 12, "MULTI_QUERY").otherwise("NONE")
