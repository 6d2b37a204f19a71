"""Line dedup with levelled sorted runs of line hashes.

The state is a folder of runs: Parquet tables (line_key, n_docs, total) whose keys are MD5 digests of lines stripped of white
space and lower-cased (A-Z). Each is bucketed by key and sorted within its buckets, all alike, so that runs are merged with
each other, and a batch with the runs, without moving a row of them. n_docs counts the documents that the run adds, total
those of all runs up to then. Documents are added in batches (by a hash of their text), one after the other:

1. count in how many documents of the batch each key stands (each document names a key once, partial sums before the
   shuffle), dealt out like the runs; the batch's own keys are all that is shuffled;
2. merge the counts with the runs, one after the other, and leave out keys whose total has reached the limit there: those
   lines are known to be frequent and need no count;
3. write the rest, with their totals, as a new sorted run of level 0.

When a level holds `fan_in` runs, they are merged into one run of the next level, adding up counts. A key is frequent
once its total reaches the limit; from then on it is left out, so it is marked in one run alone. The lines of the documents
are then looked up among the frequent keys, and each document keeps its other lines in order.

A call commits once, when all its batches are in runs: one manifest of the next number names the runs and, among the inputs
they hold, this one (by a digest of its rows, or a name that the caller gives). A job that dies before leaves runs that nothing names,
and its repetition adds its documents as if it had not been; a repetition after the commit adds nothing. Of two jobs that add to
one state at once the later one is told so by an error (Conflict) and can be run again.

Defined cases: null or empty text is one empty line; lines without a character after stripping are never dropped;
repeated rows are documents of their own in counts; null doc_id is allowed; a table without rows gives none; other
columns are not read, or carried through by clean(). Two inputs to one state with the same rows are one input unless their
names differ.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import SPACE, ascii_lower, fresh, join_keyed, only, scratch, unknown, without_columns
from loomwork.sources.commits import Manifests, names_in
from loomwork.sources.tables import file_system, shared_dir

#: A line in so many documents is boilerplate.
LEAST_DOCS = 10
BATCHES = 4
FAN_IN = 2
#: Frequent keys (33 bytes each) that are sent to every task; more are joined.
MOST_LOOKUP = 50_000
#: Of the names that the catalogue has for the tables of the state.
PREFIX = "loomwork_line_"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest_of(line: Column) -> Column:
    """MD5 in hex of the stripped, lower-cased line; null where nothing is left."""
    stripped = F.trim(line, F.lit(SPACE))
    return F.when(F.length(stripped) > 0, F.md5(ascii_lower(stripped).cast("binary")))


def key_of(line: Column) -> Column:
    return F.unhex(digest_of(line))


class LineRuns:
    """Levelled runs of line keys in a folder that the driver and the executors share; an existing one is opened.

    add() and compact() make runs; commit() makes them the state.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least_docs: int = LEAST_DOCS, fan_in: int = FAN_IN):
        self.spark, self.least_docs, self.fan_in = spark, least_docs, fan_in
        self.folder = (folder or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.inputs: list[str] = []
        self.log = Manifests(spark, self.folder, keep=1)
        self.version, state = self.log.last()
        if state:
            if state["least_docs"] != least_docs:
                raise ValueError(f"the runs were made for lines of {state['least_docs']} documents")
            self.buckets, self.inputs = state["buckets"], state["inputs"]
            self.levels.update({int(k): v for k, v in state["levels"].items()})

    def names(self) -> list[str]:
        return [n for level in self.levels.values() for n in level]

    def commit(self, input_name: str | None = None) -> None:
        """Make the runs so far the state, if it is still the one that was opened; then delete what it doesn't name."""
        if input_name:
            self.inputs = [*self.inputs, input_name]
        levels = {str(k): v for k, v in self.levels.items() if v}
        self.log.commit(self.version, {"least_docs": self.least_docs, "buckets": self.buckets, "levels": levels, "inputs": self.inputs})
        self.version += 1
        for name in set(names_in(self.spark, self.folder, "run_")) - set(self.names()):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {PREFIX}{name}")
        fs, p = file_system(self.spark, f"{self.folder}/{name}")
        fs.delete(p, True)

    def delete(self) -> None:
        fs, p = file_system(self.spark, self.folder)
        for name in names_in(self.spark, self.folder, "run_"):
            self.drop(name)
        fs.delete(p, True)

    def read(self, name: str) -> DataFrame:
        """A table of the state. The catalogue of a new session doesn't know it yet, nor that it is bucketed."""
        place = f"{self.folder}/{name}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {PREFIX}{name} (line_key BINARY, n_docs BIGINT, total BIGINT) USING parquet CLUSTERED BY (line_key) SORTED BY (line_key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(f"{PREFIX}{name}")

    def write(self, df: DataFrame) -> str:
        """df, dealt out by line_key, as a table of the state."""
        name = f"run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "line_key").sortBy("line_key").option("path", f"{self.folder}/{name}").saveAsTable(f"{PREFIX}{name}")
        return name

    def runs(self) -> list[DataFrame]:
        return [self.read(r) for level in sorted(self.levels) for r in self.levels[level]]

    def totals(self) -> DataFrame | None:
        """line_key, n_docs, total over all runs."""
        return functools.reduce(merged, self.runs()) if self.runs() else None

    def frequent(self) -> DataFrame | None:
        """The frequent keys, each once."""
        runs = [r.filter(F.col("total") >= self.least_docs).select("line_key") for r in self.runs()]
        return functools.reduce(DataFrame.unionByName, runs) if runs else None

    def fresh(self, counts: DataFrame) -> DataFrame:
        """line_key, n_docs, total of the keys of a batch that are not known to be frequent."""
        out, seen = counts.select("line_key", "n_docs", F.col("n_docs").alias("total")), F.lit(0)
        for r in self.runs():
            known = r.select("line_key", F.col("n_docs").alias("_n"), F.col("total").alias("_t"))
            both = out.join(known.hint("merge"), "line_key", "left")
            out = both.filter(F.coalesce("_t", seen) < self.least_docs).select("line_key", "n_docs", (F.col("total") + F.coalesce("_n", seen)).alias("total"))
        return out

    def add(self, counts: DataFrame) -> None:
        """Add a batch given as (line_key, n_docs) with each key once as a run, and merge the levels that are full then."""
        self.levels[0].append(self.write(self.fresh(counts)))
        self.compact()

    def compact(self) -> None:
        """Merge full levels, two runs at a time. The merged ones stay on disk until a state without them is committed."""
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            one = old[0]
            for other in old[1:]:
                one = self.write(merged(self.read(one), self.read(other)))
            self.levels[level + 1].append(one)
            level += 1


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join. (A union and a group-by of bucketed tables is no way: in Spark 4.1 the plan counts on
    the buckets while the scans may be planned without them, and keys come out twice.)"""
    zero = F.lit(0).cast("long")
    other = b.select("line_key", F.col("n_docs").alias("_n"), F.col("total").alias("_t"))
    both = a.join(other.hint("merge"), "line_key", "full")
    return both.select("line_key", (F.coalesce("n_docs", zero) + F.coalesce("_n", zero)).alias("n_docs"), F.greatest("total", "_t").alias("total"))


def batch_counts(df: DataFrame, batch: int, batches: int, buckets: int) -> DataFrame:
    """line_key, n_docs of the documents of one batch, dealt out over the buckets. A row's batch comes from the hash of its text."""
    own = only(df, "text").filter(F.pmod(F.xxhash64("text"), F.lit(batches)) == batch)
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: k.isNotNull()))
    counts = own.select(F.explode(keys).alias("line_key")).groupBy("line_key").agg(F.count(F.lit(1)).alias("n_docs"))
    # the group-by deals its keys out like the buckets, unless the runs are of a session with another number of partitions
    return counts if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) == buckets else counts.repartition(buckets, "line_key")


def name_of_input(df: DataFrame) -> str:
    """A digest of the rows of df (doc_id and text), in whatever order they come."""
    row = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return hashlib.sha256("|".join(map(str, only(df, "doc_id", "text").agg(F.count(F.lit(1)), *parts).first())).encode()).hexdigest()


def frequent_keys(df: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN, state: str | None = None, input_name: str | None = None) -> DataFrame:
    """The keys of lines in at least least_docs documents, by adding the documents to the runs batch by batch.

    state is a folder whose runs count too and stay, with these documents in them; without one the runs are deleted.
    """
    runs = LineRuns(df.sparkSession, state, least_docs, fan_in)
    name = None if state is None else input_name or name_of_input(df)
    if name is None or name not in runs.inputs:
        for b in range(batches):
            runs.add(batch_counts(df, b, batches, runs.buckets))
        if name is not None:
            runs.commit(name)
    found = scratch(runs.frequent(), "line-frequent")
    if state is None:
        runs.delete()
    return found


def lookup(hot: DataFrame) -> tuple[Column, int]:
    """The keys of hot, which the caller has counted, as a constant array of buckets, and the number of buckets.

    A bucket is a string of keys in hex with commas between them. Line keys look for themselves in their bucket within the
    row of their text.
    """
    keys = [r[0] for r in hot.select(F.lower(F.hex("line_key"))).collect()]
    buckets: list[list[str]] = [[] for _ in range(max(1, len(keys)))]
    for k in keys:
        buckets[int(k[:8], 16) % len(buckets)].append(k)
    return F.split(F.lit(";".join(",".join(b) for b in buckets)), ";"), len(buckets)


def clean(df: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, most_lookup: int = MOST_LOOKUP, state: str | None = None, input_name: str | None = None) -> DataFrame:
    """df with text less the frequent lines, and the numbers of lines before and of those dropped as _n_lines, _n_dropped.

    state is the folder of earlier documents' runs, whose lines count too and to which these are added, once for each input_name (or
    each content).

    The frequent keys are counted. Up to most_lookup of them go to all tasks as a table of buckets, and no text is
    shuffled. Beyond that, lines are joined to keys and the numbers of the dropped lines to the documents; a document is
    then known by (doc_id, digest of text), so that rows that share a doc_id don't mix.
    """
    unknown(df, ["doc_id", "text"])
    hot = frequent_keys(df, least_docs, batches, state=state, input_name=input_name)
    df = without_columns(df, "_n_lines", "_n_dropped")
    every, rest, digest, id_, of, drops = fresh(df, "_all", "_rest", "_digest", "_id", "_of", "_drops")
    split = df.withColumn(every, lines_of(F.col("text")))
    if hot.count() <= most_lookup:
        slots, buckets = lookup(hot)
        place = lambda k: F.pmod(F.conv(F.substring(k, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
        fine = lambda k: k.isNull() | ~F.contains(F.get(slots, place(k)), k)
        out = split.withColumn(rest, F.filter(every, lambda x: F.element_at(F.transform(F.array(digest_of(x)), fine), 1)))
        return out.withColumns({"text": F.array_join(rest, "\n"), "_n_lines": F.size(every).cast("long"), "_n_dropped": (F.size(every) - F.size(rest)).cast("long")}).drop(every, rest)
    sha = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    lines = df.select(F.col("doc_id").alias(id_), sha.alias(of), F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("_line", "line_key")).filter(F.col("line_key").isNotNull())
    gone = join_keyed(lines, hot, "line_key", broadcast_rows=most_lookup).groupBy(id_, of).agg(F.collect_set("_line").alias(drops))
    both = split.withColumn(digest, sha).join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(of)), "left").drop(id_, of, digest)
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.coalesce(drops, F.array().cast("array<int>")))
    text = F.when(F.col(drops).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(every), i)), "\n"))
    return both.withColumns({"text": text, "_n_lines": F.size(every).cast("long"), "_n_dropped": F.coalesce(F.size(drops), F.lit(0)).cast("long")}).drop(every, drops)


def report(df: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = clean(only(df, "doc_id", "text"), least_docs, batches)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
