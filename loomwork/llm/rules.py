"""Quality rules: a threshold table compiled into one Spark projection.

Metrics are columns made of built-in functions; a rule is a row (name, metric, least, most); compile_rules() turns the
table into one boolean column. No user functions, no shuffle: each text is judged in its own row.

Defined cases: null text counts as empty and has no words; a text without words fails the base rules; repeated rows are
judged alike, each by itself; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import SPACE_CLASS, WORD_CLASS, only, unknown

#: Words of a repeated passage.
WINDOW = 8

#: Frequent short words of the languages that the corpus has; their share tells prose from lists and junk.
STOP_WORDS = (
    "the of and to in is that for it was on are with as be by this from at or an a "
    "der die das und ist ein eine zu den von mit auf für im des dem nicht sich es in auch "
    "el la los las de que y en un una por con para es se del al lo como más su "
    "le les des et est une dans pour que qui sur pas plus par ce au du"
).split()


class Rule(NamedTuple):
    name: str
    metric: str
    least: float | None
    most: float | None


RULES = (
    Rule("words", "n_words", 20, None),
    Rule("repeated passages", "repeat_ratio", None, 0.3),
    Rule("mean word length", "mean_word_chars", 2.5, 14.0),
    Rule("symbols per word", "symbol_ratio", None, 0.1),
    Rule("stop words", "stop_ratio", 0.02, None),
    Rule("lines repeated", "dup_line_ratio", None, 0.5),
    Rule("words with a letter", "alpha_ratio", 0.7, None),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", -1), lambda w: w != "")


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metrics that rules can name. Each step is a projection of its own, so that no array is made twice."""
    window, names = F.lit(WINDOW), df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns(
        {
            "_words": words_of(F.col(text)),
            "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD_CLASS)),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        }
    )
    # the hash of each window of WINDOW words, in order
    df = df.withColumn("_hashes", F.when(F.size("_words") >= window, F.transform(F.sequence(F.lit(1), F.size("_words") - window + 1), lambda i: F.xxhash64(F.slice(F.col("_words"), i, window)))))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    # only where some window comes twice: sort (hash, place), keep those with an equal neighbour, count the words they cover
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col("_sorted"), j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_places", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(window, p - a["last"])).alias("n")), lambda a: a["n"])
    metrics = {
        "n_symbols": F.col("n_symbols"),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines_with_words": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_alpha_words": F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
    }
    # a generator of one row: filters on the metrics stay above it, else each would be written out down to the text
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in metrics.items())))).alias("_m")
    df = df.select(*names, row).select(*names, *(F.col(f"_m.{n}").alias(n) for n in metrics))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "repeat_ratio": share("n_repeat_words", "n_words"),
            "stop_ratio": share("n_stop_words", "n_words"),
            "alpha_ratio": share("n_alpha_words", "n_words"),
            "dup_line_ratio": share("n_dup_lines", "n_lines_with_words"),
        }
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """True where every rule of the table holds."""
    holds = F.lit(True)
    for r in rules:
        if r.least is not None:
            holds = holds & (F.col(r.metric) >= r.least)
        if r.most is not None:
            holds = holds & (F.col(r.metric) <= r.most)
    return holds


def judge(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the metrics, base_failed and kept."""
    unknown(df, ["doc_id", "text"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return with_metrics(only(df, "doc_id", "text")).drop("text").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
