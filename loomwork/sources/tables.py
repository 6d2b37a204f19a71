"""Tables: reading them dealt out evenly, the shared folder, tables that are built once, joins of a checked size."""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of texts, where the work on a row outweighs moving it.
TEXTS = ("documents", "pages", "conversations")
#: Values of which each reaches the pages of a Parquet scan; more are one condition of their least and largest there.
MOST_ALONE = 300
#: Rows of a side that is sent to every task.
MOST_SENT = 50_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table <folder>/<name>.parquet."""
    return spark.read.parquet(table_path(folder, name))


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """read_table() for work that outweighs moving a row: a table of texts in fewer files than cores is dealt out over all."""
    df = read_table(spark, folder, name)
    return spread(df) if name in TEXTS else df


def table_path(folder: str, name: str) -> str:
    return f"{str(folder).rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, over at least as many partitions as there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where that is unset, a local master, whose driver and executors are one process, gets a folder of its own; on any other
    master it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the files of a table (names, sizes, times), which changes when the table does."""
    fs, p = file_system(spark, path)
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
    return hashlib.sha256(repr((path, files)).encode()).hexdigest()[:24]


def built_once(spark: SparkSession, path: str, make, by: tuple[str, ...] = (), shape: str | None = None) -> DataFrame:
    """The Parquet table at path, in folders by some columns; the first call writes it from make(). shape is its schema, which a table in
    folders needs where it may be without rows.

    It is written beside and renamed when complete, so a job that dies leaves nothing that looks like the table, and of two
    that write it at once one wins.
    """
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        beside = f"{path}-{uuid.uuid4().hex}"
        make().write.partitionBy(*by).parquet(beside)
        other = spark._jvm.org.apache.hadoop.fs.Path(beside)
        if fs.exists(p) or not fs.rename(other, p):
            fs.delete(other, True)
    return (spark.read.schema(shape) if shape else spark.read).parquet(path)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back, for rows that a plan uses several times over: they are made
    once, and a lost executor takes nothing with it. They are deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def drop_kept(df: DataFrame) -> None:
    """Delete a table of kept() that no later plan reads."""
    fs, p = file_system(df.sparkSession, df._kept_path)
    fs.delete(p, True)


def any_of(column: str, values: list) -> Column:
    """column is one of the values. A scan prunes by each comparison of a disjunction, but not by a long list of values."""
    if not values:
        return F.lit(False)
    return tree([F.col(column) == v for v in sorted(values)]) if len(values) <= MOST_ALONE else F.col(column).isin(values)


def tree(conditions: list[Column]) -> Column:
    """Their disjunction, no deeper than it must be."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2], strict=False)] + ([conditions[-1]] if len(conditions) % 2 else [])
    return conditions[0]


def join_small(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", most: int = MOST_SENT, rows: int | None = None) -> DataFrame:
    """big joined to small, such as the keywords of a batch of questions, which is counted first unless a bound is known (rows).

    Up to `most` rows are sent to every task. Beyond that an equi-join is left to Spark, and an inner join on any other
    condition runs over blocks of small of about `most` rows, one after the other.
    """
    n = small.count() if rows is None else rows
    if n <= most:
        return big.join(F.broadcast(small), on, how)
    if not isinstance(on, Column):
        return big.join(small, on, how)
    if how != "inner":
        raise ValueError(f"a {how} join on a condition with {n} rows, of which {most} can be sent")
    blocks = math.ceil(n / most)
    of = F.pmod(F.xxhash64(*(small[c] for c in small.columns)), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = big.join(F.broadcast(small.filter(of == k)), on)
        out = part if out is None else out.unionByName(part)
    return out
