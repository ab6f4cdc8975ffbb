"""Runs that happen only where their input has changed, and exports that go on where the last one ended.

What a run makes is written first, then the hash of what it was made from, then the cursor.  Hash and cursor are
ledgers: numbered entries that are only added, the last of which counts.  A run that stops between the steps has left
the old entries, and is made again as if it had never begun.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import new_slice


class Ledger:
    """Entries ``n`` = 1, 2, … of a few values each, in a folder of their own; an entry is there once it is whole."""

    def __init__(self, spark: SparkSession, path: str, values: str):
        self.spark, self.path, self.schema = spark, path, f"n long, {values}"

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def last(self) -> Row | None:
        return self.entries().orderBy(F.desc("n")).first()

    def add(self, *values) -> None:
        last = self.last()
        n = last.n + 1 if last else 1
        # what a writer that died has left of this entry goes: it was never whole
        self.spark.createDataFrame([(n, *values)], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/entry-{n:012d}")


def fingerprint(rows: DataFrame) -> str:
    """A hash of a table that doesn't depend on the order of its rows; the columns' names count too."""
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 17, 33, 49)]
    got = rows.agg(F.count("*"), *parts).first()
    return "-".join(str(x or 0) for x in got)


class GatedIndex:
    """An index of a table that is built again only if the table has changed.

    ``build(rows)`` makes the index.  Folders below ``path``: index/<hash>, hash (the ledger of what was built).
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.build = spark, path, build
        self.hashes = Ledger(spark, f"{path}/hash", "hash string")

    def run(self, rows: DataFrame, force: bool = False) -> str:
        """built or skipped."""
        now, last = fingerprint(rows), self.hashes.last()
        if last and last.hash == now and not force:
            return "skipped"
        self.build(rows).write.mode("overwrite").parquet(f"{self.path}/index/{now}")
        self.hashes.add(now)
        return "built"

    def index(self) -> DataFrame | None:
        last = self.hashes.last()
        return self.spark.read.parquet(f"{self.path}/index/{last.hash}") if last else None

    def batch(self, read: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of file changes: a batch with changes runs the gate; its commit comes last of all."""

        def work(changes: DataFrame, number: int) -> None:
            if not changes.isEmpty():
                self.run(read())

        return work


def watch(index: GatedIndex, source: str, read: Callable[[], DataFrame], checkpoint: str, interval: float = 2.0):
    """Starts one look at the files below ``source``: whatever has changed since the checkpoint's cursor is offered to the gate."""
    from ..sources import changes

    changes.register(index.spark)
    stream = index.spark.readStream.format("file_changes").option("intervalSeconds", str(interval)).load(source)
    return stream.writeStream.foreachBatch(index.batch(read)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Exports:
    """Exports of a growing table, each with what is new behind the cursor: the greatest ``order`` (a number) exported.

    ``export(rows)`` writes to export/<n>; forced ones, and those of the last ``since`` rows, go to by-hand and leave the
    cursor alone.
    """

    def __init__(self, spark: SparkSession, path: str, order: str):
        self.spark, self.path, self.order = spark, path, order
        self.cursor = Ledger(spark, f"{path}/cursor", "upto long")

    def export(self, rows: DataFrame, force_all: bool = False, since: int | None = None) -> DataFrame:
        """The rows of this export, as written."""
        last = self.cursor.last()
        n, upto = (last.n, last.upto) if last else (0, None)
        by_hand = force_all or since is not None
        if by_hand:
            some = new_slice(rows, self.order, 0, since, force_all)
        else:
            some = rows if upto is None else rows.where(F.col(self.order) > upto)
        out = f"{self.path}/by-hand/{uuid.uuid4().hex}" if by_hand else f"{self.path}/export/{n + 1:012d}"
        some.write.mode("overwrite").parquet(out)
        written = self.spark.read.schema(rows.schema).parquet(out)
        if not by_hand:
            newest = written.agg(F.max(self.order)).first()[0]
            if newest is not None:
                self.cursor.add(newest)
        return written
