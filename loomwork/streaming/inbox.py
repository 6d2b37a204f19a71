"""A drop folder: files are taken once they have rested, ingested, and moved to processed/ or failed/."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from loomwork.sources.commits import LOCK_AGE_S, Lock
from loomwork.sources.tables import file_system

MIN_AGE_S = 5.0
EVERY_S = 30.0


def target_of(fs, path_of: Callable[[str], object], folder: str, name: str, now_ms: int) -> object:
    """Where a file goes: under its own name, or with the time before it if that is taken."""
    at = path_of(f"{folder}/{name}")
    return at if not fs.exists(at) else path_of(f"{folder}/{now_ms}-{name}")


def scan(spark: SparkSession, inbox: str, handle: Callable[[str], object], supported: Callable[[str], bool], min_age_s: float = MIN_AGE_S, now_ms: int | None = None, lock_age_s: float = LOCK_AGE_S) -> list[tuple[str, str]]:
    """(file name, "processed" or "failed") of the files of one look at the folder.

    Files that changed less than min_age_s ago are still being written and wait. Unsupported files, and files whose
    handle(path) raises, go to failed/. A lock keeps a second scanner out, which then does nothing; a dead scanner's is taken over
    after lock_age_s.
    """
    now = now_ms if now_ms is not None else int(time.time() * 1000)
    fs, root = file_system(spark, inbox)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for sub in ("processed", "failed"):
        fs.mkdirs(path_of(f"{inbox}/{sub}"))
    done = []
    with Lock(spark, inbox, "scan-lock", lock_age_s).held() as mine:
        files = sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(root) if s.isFile()) if mine else []
        for name, changed in files:
            if name.startswith(".") or changed > now - min_age_s * 1000:
                continue
            end = "processed"
            try:
                if not supported(name):
                    raise ValueError("unsupported file")
                handle(f"{inbox}/{name}")
            except Exception:
                end = "failed"
            fs.rename(path_of(f"{inbox}/{name}"), target_of(fs, path_of, f"{inbox}/{end}", name, now))
            done.append((name, end))
    return done


def watch(spark: SparkSession, inbox: str, handle: Callable[[str], object], supported: Callable[[str], bool], every_s: float = EVERY_S, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Scan again and again (or so many rounds); the number of files that were processed."""
    n = k = 0
    while rounds is None or k < rounds:
        n += sum(end == "processed" for _, end in scan(spark, inbox, handle, supported))
        k += 1
        if rounds is None or k < rounds:
            sleep(every_s)
    return n
