"""Approximate vector search: k-means cells as folders of Parquet, of which a query reads those with the nearest centres.

Centres are fitted to a bounded sample (the rows with the least hashes of their keys), by cosine. Every vector is then put into the cell of
its nearest centre: rows of one cell lie together, packed into blocks of BLOCK vectors, and a cell is a folder. A search packs its queries
by the cells that they probe, reads those folders, and joins blocks with blocks by cell; each pair is one product of matrices. A task
keeps the best of its queries over all blocks it sees. Nothing of corpus or queries passes the driver but the sample and the numbers of
the cells.

Defined cases: vectors that are null, zero or of another width than most lie in no cell and are not found (their cosine is 0 with all);
queries of that kind find nothing; an empty corpus has one cell without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.operators.lexical import top_k
from loomwork.operators.search import Best, cosines, matrix
from loomwork.sources.tables import MOST_SENT, built_once, kept

#: Rows that the centres are fitted to, and numbers in all of them.
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 8_000_000
#: Cells: the root of the rows, with so many rows of the sample for each at least, and rounds of fitting.
SAMPLE_PER_CELL = 20
ROUNDS = 12
#: Cells that a query reads.
PROBES = 12
#: Vectors of a block.
BLOCK = 512


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def k_means(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Unit centres of unit vectors; a cell that runs empty starts again at the vector that fits worst."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        s = x @ centres.T
        own = s.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(s.max(axis=1), kind="stable")[: len(empty)]]
        centres = unit(sums)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """blocks (cell, n, keys, vectors) of the corpus in folders by cell, and the centres of the cells, one row for each."""

    blocks: DataFrame
    centres: np.ndarray
    key: str

    @staticmethod
    def at(spark: SparkSession, path: str, corpus: DataFrame, key: str = "doc_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        """The index stored at path, which the first call builds."""
        held = built_once(spark, f"{path}/centres", lambda: spark.createDataFrame(fitted(corpus, key, vector, cells), "cell int, centre array<double>").coalesce(1))
        rows = held.orderBy("cell").collect()  # as many as there are cells
        centres = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1)
        blocks = built_once(spark, f"{path}/cells", lambda: packed(placed(corpus, centres, key, vector, 1), key), ("cell",), f"n bigint, keys array<{corpus.schema[key].dataType.simpleString()}>, vectors binary, cell int")
        return VectorIndex(blocks, centres, key)

    def probed(self, queries: DataFrame, qid: str = "query_id", vector: str = "embedding", probes: int = PROBES) -> DataFrame:
        """The queries in blocks, in each of the cells that they probe."""
        return kept(packed(placed(queries, self.centres, qid, vector, probes), qid).select("cell", F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors")), "queries-probed")

    def near(self, asked: DataFrame) -> DataFrame:
        """The blocks of the cells that are probed: their folders alone are read."""
        cells = [r[0] for r in asked.select("cell").distinct().collect()]
        return self.blocks.filter(F.col("cell").isin(sorted(cells)))

    def search(self, queries: DataFrame, k: int, qid: str = "query_id", vector: str = "embedding", probes: int = PROBES, threshold: float = 0.0) -> DataFrame:
        """qid, key, score, rank of the k best in the probed cells."""
        asked = self.probed(queries, qid, vector, probes)
        pairs = self.near(asked).join(F.broadcast(asked) if asked.count() <= MOST_SENT // BLOCK else asked, "cell")
        key, width = self.key, self.centres.shape[1]
        q_type, k_type = to_arrow_type(queries.schema[qid].dataType), to_arrow_type(self.blocks.schema["keys"].dataType.elementType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names: list = []
            place: dict = {}
            best = Best(0, k)
            full = lambda: len(names) > 50_000

            def out() -> pa.RecordBatch:
                rows = best.rows(names)
                return pa.RecordBatch.from_arrays([pa.array(rows[0], q_type), pa.array(rows[1], k_type), pa.array(rows[2], pa.float64())], [qid, key, "score"])

            for b in batches:
                for ids, m, q_ids, q in zip(*(b.column(c).to_pylist() for c in ("keys", "vectors", "q_keys", "q_vectors")), strict=True):
                    s = cosines(np.frombuffer(q).reshape(-1, width), np.frombuffer(m).reshape(-1, width))
                    for i, name in enumerate(q_ids):
                        if name not in place:
                            place[name] = len(names)
                            names.append(name)
                            best.held.append([])
                            best.least.append(-float("inf"))
                        row = s[i]
                        best.offer(place[name], np.where(row >= threshold, row, -np.inf) if threshold > 0 else row, ids)
                    if full():
                        yield out()
                        names, place, best = [], {}, Best(0, k)
            yield out()

        kinds = f"{qid} {queries.schema[qid].dataType.simpleString()}, {key} {self.blocks.schema['keys'].dataType.elementType.simpleString()}, score double"
        found = pairs.select("keys", "vectors", "q_keys", "q_vectors").mapInArrow(run, kinds).filter(F.col("score") > F.lit(-1.5))
        return top_k(found, k, qid, key)


def fitted(corpus: DataFrame, key: str, vector: str, cells: int | None) -> list[tuple[int, list[float]]]:
    """(cell, centre) from a sample of bounded size."""
    width = corpus.select(F.size(vector).alias("w")).filter("w > 0").groupBy("w").count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return [(0, [1.0])]
    own = corpus.filter(F.size(vector) == width["w"]).select(key, vector)
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // width["w"]))
    sample = own.orderBy(F.xxhash64(key), key).limit(rows).select(vector).toArrow().column(0).combine_chunks()
    x = unit(matrix(sample, width["w"]))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return [(0, [1.0] * width["w"])]
    n = cells or round(width["count"] ** 0.5)
    centres = k_means(x, max(1, min(n, len(x) // SAMPLE_PER_CELL or 1)))
    return [(i, c.tolist()) for i, c in enumerate(centres)]


def placed(df: DataFrame, centres: np.ndarray, key: str, vector: str, probes: int) -> DataFrame:
    """cell, key, vector (bytes of doubles): each row in the cells of its `probes` nearest centres."""
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        n = min(probes, len(c))
        for b in batches:
            m = matrix(b.column(1), c.shape[1])
            some = np.flatnonzero(np.linalg.norm(m, axis=1) > 0)
            s = m[some] @ c.T
            near = np.argpartition(-s, n - 1, axis=1)[:, :n] if len(some) else np.empty((0, n), np.int64)
            rows = pa.array(np.repeat(some, n))
            raw = [x.tobytes() for x in m[some]]
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).take(rows), pa.array([x for x in raw for _ in range(n)], pa.binary())], ["cell", "key", "vector"])

    return df.select(key, vector).mapInArrow(run, f"cell int, key {df.schema[key].dataType.simpleString()}, vector binary")


def packed(rows: DataFrame, key: str) -> DataFrame:
    """cell, n, keys, vectors: up to BLOCK rows of a cell in one. They are dealt by ranges of (cell, key), so a large cell is many tasks'."""
    dealt = kept(rows, "vectors-placed").repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")
    kind = rows.schema["key"].dataType
    k_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, vectors = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys], pa.list_(k_type)), pa.array([b"".join(vectors)], pa.binary())], ["cell", "n", "keys", "vectors"])

        for b in batches:
            for c, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if keys and (c != cell or len(keys) == BLOCK):
                    yield out()
                    keys, vectors = [], []
                cell = c
                keys.append(i)
                vectors.append(v)
        if keys:
            yield out()

    return dealt.mapInArrow(run, f"cell int, n bigint, keys array<{kind.simpleString()}>, vectors binary")
