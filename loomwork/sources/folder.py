"""A data source of files: `spark.read.format("loomwork_files").load(folder)` and the same as a stream.

The folder is listed once, when a read is planned; its files are dealt out to partitions of about PARTITION_BYTES, so that one large file doesn't
wait behind others, and each task opens its own files and parses them as readers.files() does. The stream's offset is the place in the
order of (time of change, name) up to which files have been read: a restart goes on from the offset in the checkpoint, and every
file is read once. Files must come with times that don't lie before those already read, as they do when they are moved or written
there; those younger than min_age_s rest until they are complete.

Folders are those that pyarrow's file systems know: local paths and URIs such as file://, hdfs:// or s3://.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomwork.sources.readers import COLUMNS, DOCUMENT, parsers_of, rows_of_file

NAME = "loomwork_files"
PARTITION_BYTES = 64_000_000
#: A file that is opened counts as so many bytes more.
OPEN_BYTES = 1_000_000


@dataclass
class Found:
    at: int
    path: str
    size: int

    @property
    def place(self) -> tuple[int, str]:
        return self.at, self.path


def listed(folder: str, min_age_s: float = 0.0) -> list[Found]:
    """The files below a folder that have rested, in the order of (time in ns, path). Names that begin with . or _ are none."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    newest = time.time_ns() - int(min_age_s * 1e9)
    infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    out = [Found(i.mtime_ns or 0, i.path, i.size or 0) for i in infos if i.type == fs.FileType.File and i.base_name[:1] not in "._"]
    return sorted((f for f in out if f.at <= newest), key=lambda f: f.place)


class Files(InputPartition):
    def __init__(self, folder: str, paths: list[str]):
        self.folder, self.paths = folder, paths


def planned(folder: str, found: list[Found], most: int) -> list[InputPartition]:
    """Files in partitions of about `most` bytes, large ones first, each to the partition with the fewest bytes."""
    n = max(1, min(len(found), -(-sum(f.size + OPEN_BYTES for f in found) // most)))
    held: list[tuple[int, list[str]]] = [(0, []) for _ in range(n)]
    for f in sorted(found, key=lambda f: (-f.size, f.path)):
        k = min(range(n), key=lambda i: held[i][0])
        held[k] = held[k][0] + f.size + OPEN_BYTES, [*held[k][1], f.path]
    return [Files(folder, paths) for _, paths in held if paths]


def read_files(part: Files, granularity: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(part.folder)[0] if "://" in part.folder else fs.LocalFileSystem()
    known = parsers_of(granularity)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
    for path in part.paths:
        with system.open_input_stream(path, compression=None) as f:
            rows = rows_of_file(path, f.read(), known)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.granularity = options["path"], options.get("granularity", "page")
        self.bytes, self.min_age_s = int(options.get("partitionbytes", PARTITION_BYTES)), float(options.get("minages", 0))

    def partitions(self) -> list[InputPartition]:
        return planned(self.folder, listed(self.folder, self.min_age_s), self.bytes) or [Files(self.folder, [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.granularity)


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.batch = FolderReader(options)

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.batch.folder, self.batch.min_age_s)
        return {"at": found[-1].at, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["at"], start["path"]), (end["at"], end["path"])
        return planned(self.batch.folder, [f for f in listed(self.batch.folder) if after < f.place <= upto], self.batch.bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.batch.granularity)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Options: path; granularity (page or paragraph); partitionBytes; minAgeS."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DOCUMENT

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("path"):
            raise ValueError("a folder is needed: load(path)")
        return options

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self._options())


def read_folder(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format(NAME).options(**options).load(folder)


def stream_folder(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.readStream.format(NAME).options(**options).load(folder)
