"""The model boundary. Whatever needs a model takes one of these; the offline ones are deterministic."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import tokens
from loomwork.operators.evaluate import overlap_judge
from loomwork.operators.prompt import extractive_answer
from loomwork.operators.query_transforms import classify


class TextModel(Protocol):
    def __call__(self, prompt: Column) -> Column: ...


class Judge(Protocol):
    def __call__(self, answer: Column, context: Column) -> Column: ...


def no_text(prompt: Column) -> Column:
    """A model that is not there: every caller falls back to its input."""
    return F.lit(None).cast("string")


def keyword_rewrite(query: Column) -> Column:
    """Rewrites a query to its distinct terms."""
    return F.array_join(F.array_distinct(tokens(query)), " ")


def variants(query: Column) -> Column:
    """Three variants of a query: its terms, its terms reversed, its longest terms."""
    t = F.array_distinct(tokens(query))
    return F.array(F.array_join(t, " "), F.array_join(F.reverse(t), " "), F.array_join(F.filter(t, lambda x: F.length(x) > 5), " "))


def hypothetical(query: Column) -> Column:
    """A passage that would answer the query, for HyDE: a statement made of its terms. Queries without terms have none."""
    t = tokens(query)
    return F.when(F.size(t) > 0, F.concat(F.lit("It is known about "), F.array_join(F.array_distinct(t), ", "), F.lit(".")))


def step_back(query: Column) -> Column:
    """A more general query: the three longest terms, in the order of the query."""
    t = F.array_distinct(tokens(query))
    longest = F.slice(F.array_sort(F.transform(t, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), 1, 3)
    return F.array_join(F.transform(F.array_sort(F.transform(longest, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"]), " ")


def relevant(answer: Column, query: Column) -> Column:
    """A deterministic judge of relevance: the answer shares a term with the query. Blank answers and queries pass."""
    a, q = tokens(answer), tokens(query)
    return (F.size(a) == 0) | (F.size(q) == 0) | F.arrays_overlap(a, q)


def enough(query: Column, context: Column, least: float = 0.5) -> Column:
    """A deterministic judge of sufficiency: the context has enough of the query's distinct terms."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(True)).otherwise(F.size(F.array_intersect(q, tokens(context))) / F.size(q) >= least)


answer: TextModel = extractive_answer
judge: Judge = overlap_judge
strategy = classify
