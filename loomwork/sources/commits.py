"""Commits that two writers can't both make: files that appear once and whole, numbered manifests, locks that grow old."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from loomwork.sources.tables import file_system

#: Seconds after which a lock whose owner hasn't renewed it is taken over.
LOCK_AGE_S = 600.0


class Conflict(RuntimeError):
    """Another writer has committed what this one was about to."""


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file at path with this text, at once; False, and nothing is done, if it is there already.

    The text is written beside it and gets the name in one step that fails where the name is taken: a link in a local folder, a
    rename without overwriting elsewhere.
    """
    fs, p = file_system(spark, path)
    beside = p.getParent().suffix(f"/.{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if p.toUri().getScheme() in (None, "file"):
        try:
            os.link(beside.toUri().getPath(), p.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(beside, False)
    return renamed_once(spark, fs, beside, p)


def renamed_once(spark: SparkSession, fs, beside, p) -> bool:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    no_overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, p, no_overwrite)
        return True
    except Exception:
        if not fs.exists(p):
            raise
        fs.delete(beside, False)
        return False


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str, start: str = "") -> list[str]:
    """Sorted names in a folder; none if it isn't there."""
    fs, p = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith(start))


class Manifests:
    """Numbered states of what lies in a folder. A commit makes the next number, which only one writer can.

    A state is a JSON object. Its entry "applied" says up to which batch each application's batches are in it, so that a batch
    that is replayed can be told.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _at(self, n: int) -> str:
        return f"{self.folder}/manifest-{n:08d}.json"

    def numbers(self) -> list[int]:
        return [int(n[9:17]) for n in names_in(self.spark, self.folder, "manifest-") if n.endswith(".json")]

    def read(self, n: int) -> dict:
        return json.loads(read_text(self.spark, self._at(n)))

    def last(self) -> tuple[int, dict | None]:
        """The newest number and state; another writer may delete older ones meanwhile, hence the second look."""
        for _ in range(5):
            known = self.numbers()
            if not known:
                return 0, None
            try:
                return known[-1], self.read(known[-1])
            except Exception:
                if self.numbers() == known:
                    raise
        raise RuntimeError("manifests change faster than they can be read")

    def commit(self, after: int, state: dict) -> list[dict]:
        """Make `state` the one after number `after`, or raise Conflict. The states that are no longer kept are returned."""
        fs, p = file_system(self.spark, self.folder)
        fs.mkdirs(p)
        if not put_once(self.spark, self._at(after + 1), json.dumps(state)):
            raise Conflict(f"{self._at(after + 1)} is another writer's")
        gone = []
        for n in self.numbers()[: -self.keep]:
            try:
                gone.append(self.read(n))
                fs.delete(file_system(self.spark, self._at(n))[1], False)
            except Exception:  # another writer was faster
                continue
        return gone


def is_applied(state: dict | None, batch: tuple[str, int] | None) -> bool:
    return bool(batch and state and state.get("applied", {}).get(batch[0], -1) >= batch[1])


def applied_with(state: dict | None, batch: tuple[str, int] | None) -> dict[str, int]:
    known = dict((state or {}).get("applied", {}))
    return known | {batch[0]: batch[1]} if batch else known


def until_committed[T](attempt: Callable[[], T], most: int = 20) -> T:
    """attempt's result; after a Conflict it is made again on the newest state."""
    for n in range(most):
        try:
            return attempt()
        except Conflict:
            if n == most - 1:
                raise
            time.sleep(0.05 * (n + 1))
    raise AssertionError


class Lock:
    """A lock in a folder: files .<name>-<number>, of which the highest holds (.<name> is number 0). It says who its owner is.

    The owner renews the file's time while it holds the lock. A file that hasn't been renewed for `age_s` is a dead owner's: whoever makes
    the next number holds the lock then, which only one can.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, age_s: float = LOCK_AGE_S, owner: str | None = None):
        self.spark, self.folder, self.name, self.age_s = spark, folder.rstrip("/"), name, age_s
        self.owner = owner or f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"

    def _files(self) -> list[tuple[int, int]]:
        """(number, time in ms) of the files."""
        fs, p = file_system(self.spark, self.folder)
        found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = ((n.removeprefix(f".{self.name}"), t) for n, t in found if n.startswith(f".{self.name}"))
        return sorted((int(n[1:] or 0), t) for n, t in numbers if not n or n[0] == "-" and n[1:].isdigit())

    def _path(self, n: int) -> str:
        return f"{self.folder}/.{self.name}-{n:08d}" if n else f"{self.folder}/.{self.name}"

    def take(self) -> int | None:
        """The number of the lock if it could be taken."""
        fs, p = file_system(self.spark, self.folder)
        fs.mkdirs(p)
        files = self._files()
        if files and files[-1][1] > (time.time() - self.age_s) * 1000:
            return None
        n = files[-1][0] + 1 if files else 1
        if not put_once(self.spark, self._path(n), json.dumps({"owner": self.owner})):
            return None
        for old, _ in files:
            self.give(old)
        return n

    def give(self, n: int) -> None:
        fs, p = file_system(self.spark, self._path(n))
        fs.delete(p, False)

    def renew(self, n: int) -> None:
        fs, p = file_system(self.spark, self._path(n))
        fs.setTimes(p, int(time.time() * 1000), -1)

    def holder(self) -> str | None:
        files = self._files()
        return json.loads(read_text(self.spark, self._path(files[-1][0])))["owner"] if files else None

    @contextmanager
    def held(self) -> Iterator[bool]:
        """Whether the lock is held within the block."""
        n = self.take()
        if n is None:
            yield False
            return
        done = threading.Event()

        def beat() -> None:
            while not done.wait(self.age_s / 4):
                self.renew(n)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield True
        finally:
            done.set()
            thread.join()
            self.give(n)
