"""A streaming source of file changes: each file that is new or has changed since the cursor, once."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, modified_us long, size long"
#: Seconds between two looks at the files.
INTERVAL_S = 2.0


def listed(path: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, modified, size) of the files below a path, in any store that Arrow reads, in order of time."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [(f.path, f.mtime_ns // 1000, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))]
    return sorted(files, key=lambda f: (f[1], f[0]))


def changed(files: list[tuple[str, int, int]], cursor: dict) -> list[tuple[str, int, int]]:
    """Files past the cursor: later than its time, or of its time and not among those it has seen."""
    return [f for f in files if f[1] > cursor["modified_us"] or f[1] == cursor["modified_us"] and f[0] not in cursor["seen"]]


def moved(cursor: dict, fired: list[tuple[str, int, int]], now: float) -> dict:
    """The cursor behind the files that fired; without one only the time of the look is new."""
    if not fired:
        return {**cursor, "looked": now}
    last = fired[-1][1]
    before = cursor["seen"] if last == cursor["modified_us"] else []
    return {"modified_us": last, "seen": sorted({*before, *(f[0] for f in fired if f[1] == last)}), "looked": now}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.interval, self.since = float(options.get("intervalSeconds", INTERVAL_S)), int(options.get("sinceUs", -1))
        self.looked = 0.0

    def initialOffset(self) -> dict:
        return {"modified_us": self.since, "seen": [], "looked": 0.0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = time.time()
        if 0 <= now - max(start["looked"], self.looked) < self.interval:
            return iter(()), start
        self.looked = now
        fired = changed(listed(self.path, self.suffix), start)
        return iter(fired), moved(start, fired, now) if fired else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch again, after a restart: files that have changed once more since then are in a later one."""
        files = changed(listed(self.path, self.suffix), start)
        return iter([f for f in files if f[1] < end["modified_us"] or f[1] == end["modified_us"] and f[0] in end["seen"]])


class FileChanges(DataSource):
    """``spark.readStream.format("file_changes").load(path)``: path, modified_us, size of files that changed.

    The offset is the cursor: the time of the last change that fired, with the names of that time's files, as two may
    change at once.  It is in the query's checkpoint, so a restart goes on behind it.  A file that hasn't changed
    fires once; one that changes twice between two looks fires once, with its last time.  Options: suffix,
    intervalSeconds (2; looks in between see nothing), sinceUs (changes up to then are old).
    """

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileChanges)
