"""Operator 5: document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, slice_count

#: Characters of a k-gram and k-grams of a window: any passage of K + W - 1 = 47 characters that two texts
#: share leaves a fingerprint in both; about one k-gram in 16 is kept.
K, W = 16, 32
MOST_SLICES = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of each k-gram of code points; a shorter text is one gram.

    The sum of code * base ** place over a k-gram, for all at once, by doubling: the hash of 2 m
    characters is that of the first m times base ** m plus that of the next m.
    """
    if len(codes) < k:
        k = len(codes)
    if not k:
        return np.zeros(0, dtype=np.uint64)
    part, size, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    whole, done = None, 0
    left = k
    while True:
        if left & 1:  # appends the part of this size behind what is done
            if whole is None:
                whole, done = part, size
            else:
                n = len(codes) - done - size + 1
                whole, done = whole[:n] * power + part[done : done + n], done + size
        left >>= 1
        if not left:
            break
        n = len(part) - size
        part, size, power = part[:n] * power + part[size : size + n], 2 * size, np.uint64(int(power) ** 2 % 2**64)
    h = whole * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * _BASE >> np.uint64(32)


def winnow(text: str, k: int = K, w: int = W) -> np.ndarray:
    """Selected k-grams, as hash * 2 ** 32 + place, by place: the least of each window, the rightmost of equals.

    A text with fewer than w k-grams is one window; an empty text has none.
    """
    h = rolling(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), k)
    n = len(h)
    if not n:
        return h
    last = np.uint64(0xFFFFFFFF)
    key = (h << np.uint64(32)) | (last - np.arange(n, dtype=np.uint64))  # less: less hash, or further right
    size, w = 1, min(w, n)
    while 2 * size <= w:
        key, size = np.minimum(key[:-size], key[size:]), 2 * size
    if size < w:
        key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & ~last) | (last - (key & last))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the hashes of two fingerprints; of two empty ones 1."""
    a, b = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def printed(chosen: np.ndarray) -> str:
    """16 hexadecimal digits for each selected k-gram: 8 of its hash, 8 of its place."""
    return chosen.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame, slices: int) -> DataFrame:
    """(slice, doc_id, text, halo): the documents in ascending order of doc_id by slices, each slice followed by the
    first row of the next one (of the first slice, after the last), as halo.  There are at most MOST_SLICES slices: above 40 M
    documents a slice holds more of them, read one after another, never at once.

    Bounds come from the ids alone; texts move once.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    bounds = ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", [(i + 1) / slices for i in range(slices - 1)], 100_000).alias("b")).first().b if slices > 1 else None
    bounds = sorted(set(bounds or ()))
    number = F.lit(0) if not bounds else F.when(F.col("doc_id").isNull(), 0).otherwise(F.aggregate(F.array(*[F.lit(b) for b in bounds]), F.lit(0),
        lambda n, b: n + (b < F.col("doc_id")).cast("int")))
    if len(bounds) > 256:  # too long for an expression: a search in the sorted bounds
        at = np.array(bounds)
        number = F.when(F.col("doc_id").isNull(), 0).otherwise(F.pandas_udf(lambda s: s.__class__(np.searchsorted(at, s.fillna(at[0]).to_numpy(), side="left")), "int")("doc_id"))
    sliced = docs.withColumn("slice", number.cast("int"))
    # the least id of each slice that has rows, and the slice before it: as many rows as slices
    heads = sliced.groupBy("slice").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    found = sorted((r.slice, None if r.has_null else r.head) for r in heads.collect())
    if not found:
        return sliced.withColumn("halo", F.lit(False))
    table = spark.createDataFrame([(s, head, found[i - 1][0]) for i, (s, head) in enumerate(found)], f"_s int, _head {docs.schema['doc_id'].dataType.simpleString()}, _before int")
    first = F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("slice") == F.col("_s"))
    halo = F.when(F.col("_before").isNotNull(), F.array(F.struct(F.col("slice"), F.lit(False).alias("halo")),
        F.struct(F.col("_before").alias("slice"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(F.col("slice"), F.lit(False).alias("halo"))))
    both = sliced.join(F.broadcast(table), first, "left").select("doc_id", "text", F.explode(halo).alias("to"))
    return both.select("to.slice", "doc_id", "text", "to.halo")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs(doc_id, text)``.

    The next document has the next higher id, of equal ids the greater text; after the last comes the
    first; null ids come first.  A single document follows itself.  A null text is an empty one, with an
    empty fingerprint.  Repeated rows are documents of their own; an empty table gives an empty one;
    other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    total = docs.count()
    parts = max(1, min(slice_count(total, 2_000), MOST_SLICES))
    sliced = in_order(docs, parts)
    ordered = sliced.repartition(parts, "slice").sortWithinPartitions("slice", "halo", "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, chars = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal chars
            chars = 0
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], k or id_type) for i, k in enumerate(kinds)], names)
            ready.clear()
            return batch

        held, id_type = None, None
        for b in batches:
            id_type = b.column(1).type
            for part, doc, text, halo in zip(*[b.column(i).to_pylist() for i in range(4)]):
                own = winnow(text)
                if held and held[0] == part:
                    _, before, words, marks = held
                    new = edited(words, text)
                    marked = winnow(new)
                    ready.append((before, len(words), hashlib.sha256(new.encode()).hexdigest(), printed(marks), printed(marked), likeness(marks, marked), likeness(marks, own)))
                    chars += len(words)
                held = None if halo else (part, doc, text, own)
                if len(ready) == 2_000 or chars > 8_000_000:
                    yield flush()
        if ready:
            yield flush()

    return ordered.mapInArrow(work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
