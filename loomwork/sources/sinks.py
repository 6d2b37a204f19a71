"""The chunk store: a Parquet table in parts by a hash of the identity, of which a write replaces only those it touches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import lifecycle
from loomwork.operators.caches import stamped
from loomwork.plans.jobs import with_retry
from loomwork.sources.commits import LOCK_AGE_S, Lock, Manifests, applied_with, is_applied, names_in, until_committed
from loomwork.sources.tables import file_system

#: Rows behind a part of a new table.
PART_ROWS = 200_000
#: Seconds after which files that no manifest has named are a dead writer's.
ORPHAN_S = 86_400.0


class ChunkStore:
    """Versions of one table below a folder; the newest manifest names the files of the table.

    A write puts the parts it touches beside the old ones and then makes the manifest of the next number, so a reader never sees
    half of it and a job that dies leaves the table as it was. Of two writers at once one makes that manifest. The other one
    looks at what has changed: if none of its parts has, it adds its files to the new state; otherwise it does its work again
    on the new state. So no write is lost. With batch=(application, number) a write is made once: a batch that an application replays,
    with a number that is in the table already, changes nothing.

    An identity's rows are in one part, which is the index for lookups and deletes by identity. Files that the last `keep`
    manifests don't name are removed. Writes that fail are tried again.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None, keep: int = 2, attempts: int = 3, orphan_s: float = ORPHAN_S):
        self.spark, self.path, self.parts, self.attempts, self.orphan_s = spark, path.rstrip("/"), parts, attempts, orphan_s
        self.log = Manifests(spark, self.path, keep)

    def versions(self) -> list[int]:
        """Numbers of the kept states, the oldest first."""
        return self.log.numbers()

    def _last(self) -> dict | None:
        return self.log.last()[1]

    def _read(self, state: dict, parts: list[int] | None = None) -> DataFrame:
        shape = T.StructType.fromJson(state["shape"])
        paths = [f"{self.path}/{v}/_part={k}" for k, v in sorted(state["parts"].items()) if parts is None or int(k) in parts]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def read(self) -> DataFrame | None:
        state = self._last()
        return None if state is None else self._read(state)

    def _part(self, n: int) -> Column:
        return F.pmod(F.xxhash64("identity"), F.lit(n)).cast("int")

    def _put(self, rows: DataFrame, n: int) -> dict[str, str]:
        """Write rows in n parts; the folder of each part."""
        name = f"v{time.time_ns():020d}"

        def put() -> None:
            rows.withColumn("_part", self._part(n)).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/{name}")

        with_retry(put, self.attempts, name="chunk store write")
        return {x.partition("=")[2]: name for x in names_in(self.spark, f"{self.path}/{name}", "_part=")}

    def _change(self, make: Callable[[dict | None], tuple[DataFrame, int, list[int] | None] | None], batch: tuple[str, int] | None = None) -> DataFrame:
        """Commit what make(state) returns: rows of the touched parts (all if None) and the number of parts; None changes nothing."""
        made: tuple | None = None

        def attempt() -> DataFrame:
            nonlocal made
            at, old = self.log.last()
            if is_applied(old, batch):
                return self._read(old)
            if made is None or not self._still_fits(made, old):
                change = make(old)
                if change is None:
                    return self._read(old)
                rows, n, touched = change
                seen = {k: (old or {}).get("parts", {}).get(str(k)) for k in touched or []}
                made = self._put(rows, n), n, touched, seen, json.loads(rows.schema.json())
            written, n, touched, _, shape = made
            kept = {k: v for k, v in (old["parts"] if old and touched is not None else {}).items() if int(k) not in touched}
            gone = self.log.commit(at, {"n": n, "shape": shape, "parts": kept | written, "applied": applied_with(old, batch)})
            self._sweep(gone)
            return self.read()

        return until_committed(attempt)

    def _still_fits(self, made: tuple, now: dict | None) -> bool:
        """Whether the parts that a write has read are still those of the table."""
        _, n, touched, seen, shape = made
        if touched is None:
            return True
        return now is not None and now["n"] == n and now["shape"] == shape and all(now["parts"].get(str(k)) == v for k, v in seen.items())

    def _sweep(self, gone: list[dict]) -> None:
        """Delete the files of states that aren't kept any more, and those that a dead writer has left."""
        named = {v for n in self.log.numbers() for v in self.log.read(n)["parts"].values()}
        before = f"v{int((time.time() - self.orphan_s) * 1e9):020d}"
        old = {v for state in gone for v in state["parts"].values()}
        for name in names_in(self.spark, self.path, "v"):
            if name not in named and (name in old or name < before):
                fs, p = file_system(self.spark, f"{self.path}/{name}")
                fs.delete(p, True)

    def write(self, df: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Replace the table. The number of its parts follows from its rows unless it was given."""
        return self._change(lambda _: (df, self.parts or max(1, -(-df.count() // PART_ROWS)), None), batch)

    def store(self, chunks: DataFrame, embed, model: str, now: Column, batch: tuple[str, int] | None = None) -> DataFrame:
        """Upsert chunks with their vectors and the model's stamp: records and vectors are one table and one write."""
        return self.upsert(stamped(chunks, embed(chunks, "chunk_id", "content"), model), now, batch)

    def _touched(self, keys: DataFrame, n: int) -> list[int]:
        """Parts of the identities: at most as many numbers as there are parts."""
        return [r[0] for r in keys.select(self._part(n).alias("k")).distinct().collect()]

    def upsert(self, chunks: DataFrame, now: Column, batch: tuple[str, int] | None = None) -> DataFrame:
        def make(old: dict | None):
            if old is None:
                rows = chunks.withColumns({"created_at": now, "updated_at": now})
                n = self.parts or max(1, -(-rows.count() // PART_ROWS))
                return rows, n, list(range(n))  # all parts are new: another first write must not be replaced
            parts = self._touched(chunks, old["n"])
            return lifecycle.upsert(self._read(old, parts), chunks, "chunk_id", now), old["n"], parts

        return self._change(make, batch)

    def find(self, ids: DataFrame) -> DataFrame:
        return lifecycle.find(self.read(), ids)

    def of_identities(self, identities: DataFrame) -> DataFrame:
        """The chunks of identities, read from their parts alone."""
        state = self._last()
        parts = self._touched(identities, state["n"])
        return self._read(state, parts).join(identities.select("identity").distinct(), "identity", "left_semi")

    def delete(self, identities: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        def make(old: dict | None):
            parts = self._touched(identities, old["n"])
            return lifecycle.delete(self._read(old, parts), identities), old["n"], parts

        return self._change(make, batch)

    def delete_all(self) -> DataFrame:
        return self._change(lambda old: (self._read(old).limit(0), old["n"], None))

    def delete_where(self, condition: Column) -> DataFrame:
        """Delete by a metadata filter (equality or a range, which reach the Parquet scan); parts without a hit stay."""

        def make(old: dict | None):
            parts = self._touched(self._read(old).filter(condition), old["n"])
            return (self._read(old, parts).filter(~F.coalesce(condition, F.lit(False))), old["n"], parts) if parts else None

        return self._change(make)

    def rebuild(self, documents: DataFrame, ingest, now: Column) -> DataFrame:
        """Replace everything by what ingest(documents) makes, without looking at what is known; one rebuild at a time."""
        with self.alone("rebuild"):
            return self.write(ingest(documents).withColumns({"created_at": now, "updated_at": now}))

    @contextmanager
    def alone(self, what: str, age_s: float = LOCK_AGE_S):
        """A lock in the store's folder: whoever finds it held gets an error. A dead owner's is taken over after age_s."""
        lock = Lock(self.spark, self.path, f"lock-{what}", age_s)
        with lock.held() as mine:
            if not mine:
                raise RuntimeError(f"another {what} is running: {lock.holder()}")
            yield
