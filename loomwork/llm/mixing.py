"""Mixing sources to target weights by Poisson replication.

Each source has a target weight; its mean repetition is weight * total / (its rows). A row's number of copies is the
inverse of the Poisson distribution with that mean at a number in [0, 1) taken from a hash of seed and doc_id, so a run
can be repeated, a task can be redone, and no row waits for another. Rows are exploded by their count and dealt by a hash of
(seed, doc_id, copy), which is the global shuffle.

A mean above PART is split into equal parts whose counts, each with a hash of its own, are added: exp(-mean) then never
vanishes and the sum is a Poisson count still.

Defined cases: a null source is a source of its own; a source without a weight or with weight 0 gives no rows; null
doc_id hashes as the empty string; rows with one doc_id get the same count, each by itself; null or empty texts are
rows like others; a table without rows gives none; other columns are carried through, but for
those with the names of the three new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import fresh, join_keyed, only, scratch, unknown, without_columns

SEED = 20240
#: Means above this are split.
PART = 16.0
#: Terms of the distribution that are tried for a mean of at most PART; what lies beyond is below 1e-40.
TERMS = 110
#: Target weights are the sources' shares to this power, scaled to add up to 1.
POWER = 0.5


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of the MD5 of the parts joined by '|'."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as they rise and are below 1: an array that is made once for each source."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("upto"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["upto"], F.array(F.element_at(a["upto"], -1) + p)).alias("upto"))

    every = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["upto"])
    return F.filter(F.array_distinct(every), lambda x: x < 1.0)


def parts_of(mean: Column) -> Column:
    return F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")


def inverted(doc_id: Column, parts: Column, steps_: Column, seed: int) -> Column:
    """How many of the steps are at most the row's number, added up over the parts."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))

    def each(j: Column) -> Column:
        # the number is made once for all steps
        return F.element_at(F.transform(F.array(uniform(str(seed), name, j.cast("string"))), lambda u: F.size(F.filter(steps_, lambda x: x <= u))), 1)

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + each(j))


def copies(doc_id: Column, mean: Column, seed: int) -> Column:
    parts = parts_of(mean)
    return inverted(doc_id, parts, steps(mean / parts), seed)


def rates(df: DataFrame, weights: DataFrame | None = None, by: str = "source", power: float = POWER) -> DataFrame:
    """_key, parts, steps: in how many parts each source's mean repetition is drawn, and the steps of a part. weights has (_by, weight) and adds up to 1; by
    default a weight is the source's share to the given power, scaled. All rows are counted, with partial sums first.
    """
    n = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    one_row = n.agg(F.sum("_n").alias("_total"), F.sum(F.pow("_n", F.lit(power))).alias("_sum"))
    n = n.crossJoin(F.broadcast(one_row))
    if weights is None:
        n = n.withColumn("weight", F.pow("_n", F.lit(power)) / F.col("_sum"))
    else:
        n = n.join(weights.withColumnRenamed("_by", "_name"), F.col("_by").eqNullSafe(F.col("_name")))
    mean = n.select(name_of(F.col("_by")).alias("_key"), (F.col("weight") * F.col("_total") / F.col("_n")).alias("mean")).filter("mean > 0")
    return mean.select("_key", parts_of(F.col("mean")).alias("parts"), steps(F.col("mean") / parts_of(F.col("mean"))).alias("steps"))


def name_of(c: Column) -> Column:
    """A join key that a null source has too."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def mix(df: DataFrame, weights: DataFrame | None = None, by: str = "source", seed: int = SEED, power: float = POWER) -> DataFrame:
    """The columns of df with _copy (1..n), _copies (n) and _mix (the key of the shuffle), one row for each copy."""
    unknown(df, ["doc_id", by])
    df = without_columns(df, "_copy", "_copies", "_mix")
    key, parts, steps_ = fresh(df, "_key", "_parts", "_steps")
    rate = scratch(rates(only(df, by), weights, by, power), "mix-rates").toDF(key, parts, steps_)
    rated = join_keyed(df.withColumn(key, name_of(F.col(by))), rate, key).drop(key)
    # each explode is a step of its own in the plan, so that the number of copies is worked out once a row
    counted = rated.withColumn("_copies", F.explode(F.array(inverted(F.col("doc_id"), F.col(parts), F.col(steps_), seed)))).drop(parts, steps_)
    each = counted.withColumn("_copy", F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies")))))
    dealt = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_copy").cast("string"), F.lit("mix")).cast("binary"))
    return each.withColumn("_mix", dealt).repartition("_mix").sortWithinPartitions("_mix")
