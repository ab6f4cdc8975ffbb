"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Maps the bytes of A-Z to those of a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BATCH_BYTES, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of 8 MB; the session's own choice stands, where it has made one.

    A worker holds a batch and the next one: of the default of 64 MB each, a few workers would fill an executor.
    """
    if spark.conf.get(_BATCH_BYTES, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH_BYTES, "8388608b")


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: reused workers wait between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone.

    Columns are found by place, so that other columns whose names differ only in case,
    repeat, or equal a name used inside an operator do no harm.
    """
    small_batches(df.sparkSession)
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{p}").alias(n) for p, n in zip(places, names)])


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as c0, c1, ... with k1 and k2, 128 bits of hashes of each row's doc_id and text; and doc_id, text, k1 and k2 alone."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    own = [F.col(f"c{columns.index(n)}") for n in ("doc_id", "text")]
    parts = [x for c in own for x in (c.isNull(), c)]
    plain = plain.withColumn("k1", F.xxhash64(F.lit(1), *parts)).withColumn("k2", F.xxhash64(F.lit(2), *parts))
    return plain, plain.select(own[0].alias("doc_id"), own[1].alias("text"), "k1", "k2")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session names none, a local one (tests) gets a temporary folder; on a cluster that would be lost
    with its machine, or never seen by the others, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, in files that outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slice_count(rows: int, per_slice: int = 50_000) -> int:
    """Into how many slices a group may be split so that a slice stays small."""
    return max(16, -(-rows // per_slice))


def running_totals(df: DataFrame, group: list[str], spread: list[str], order: list[str], amount: str | None, slices: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` (None: the number of rows) over the rows before, within ``group``.

    A group may hold most rows, so it is never one task: its rows fall into ``slices`` slices by a
    hash of ``spread``, come in order of ``order`` within a slice, and slices follow one another.
    Slice totals are added up first; there are at most ``slices`` of them in a group.
    """
    value = F.lit(1).cast("long") if amount is None else F.col(amount)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(slices)).cast("int"))
    keys = [*group, "_slice"]
    totals = sliced.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = sliced.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(starts, on)
    return joined.withColumn(out, (F.col("_start") + F.col("_inner")).cast("long")).drop("_slice", "_start", "_inner", *[f"_k{i}" for i in range(len(keys))])


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is a file of the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
