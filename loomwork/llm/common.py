"""What the training-data operators share: reading tables, shared scratch tables, size-checked joins, Arrow batches."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.tables import file_system, shared_dir
from loomwork.sources.tables import read_spread as table

#: White space of the word and line contracts.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def scratch(df: DataFrame, tag: str, *sort: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a table of scratch() that no later plan reads."""
    fs, p = file_system(df.sparkSession, df._scratch_path)
    fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does once the driver has collected their handles.

    The handles of Python's objects go first, those of the JVM after them, hence two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


def join_keyed(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", broadcast_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Join big to small, whose key is unique, without one hot key of big landing in one task.

    small is counted first (it should be a scratch table). Up to broadcast_rows it is broadcast. Beyond that it is
    replicated salts times and both sides are shuffled by (key, salt), which splits every key of big over salts tasks. Spark
    would take the copies for no larger than small's compressed files and could send them through the driver, hence the hint.
    """
    keys = [key] if isinstance(key, str) else key
    if small.count() <= broadcast_rows:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return spread.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def join_counted(big: DataFrame, small: DataFrame, keys: str | list[str], broadcast_rows: int = 50_000, least_hot: int = 1_000) -> DataFrame:
    """big joined to small, a table with one row for each key and the number of big's rows with it as _n, without a hot key.

    Up to broadcast_rows rows small is sent to every task. Beyond that only the keys of many rows are: those above one
    part in broadcast_rows of all, of which there can't be more than broadcast_rows. The others are left to a join by key,
    which is never a broadcast: small's compressed files say little of its size on the driver.
    """
    keys = [keys] if isinstance(keys, str) else keys
    n, total = small.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if n <= broadcast_rows:
        return big.join(F.broadcast(small.drop("_n")), keys)
    hot = F.col("_n") > max(least_hot, total // max(broadcast_rows, 1))
    frequent, rest = F.broadcast(small.filter(hot).drop("_n")), small.filter(~hot).drop("_n")
    return big.join(frequent, keys).unionByName(big.join(F.broadcast(small.filter(hot).select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() does that by itself where each character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text, or one row where a row is longer."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no other, so that extra columns of an input can't clash with those an operator makes."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has as columns already (Spark doesn't mind case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """df without its own columns of these names, which an operator is about to make."""
    gone = {n.lower() for n in names}
    return only(df, *(c for c in df.columns if c.lower() not in gone))


def unknown(df: DataFrame, needed: Sequence[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
