"""Operator 6: best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, running_totals, slice_count
from .tokens import id_bytes, id_encoder

VOCABULARY = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048
END_ID = 0


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = SEQUENCE_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids
    end, width = id_bytes([END_ID]), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = id_encoder(vocabulary)
        for b in batches:
            row, piece, length, crc, ids = [], [], [], [], []
            ids_of, starts = lib.batch_ids(b.column(1))
            every, places = memoryview(ids_of).cast("B"), (4 * starts).tolist()
            for i, (first, last) in enumerate(zip(places, places[1:])):
                data = bytes(every[first:last]) + end
                for k, at in enumerate(range(0, len(data), width)):
                    some = data[at : at + width]
                    row.append(i)
                    piece.append(k)
                    length.append(len(some) // 4)
                    crc.append(zlib.crc32(some))
                    if keep_ids:
                        ids.append(some)
            pieces = np.array(piece, dtype=np.int32)
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(pieces), pa.array(pieces.astype(np.int64) * capacity), pa.array(length,
                pa.int32()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
        lib.forget()

    return docs.mapInArrow(encode, schema)


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces a sequence, offset) of runs of equal placements.

    Supersteps from the longest length to the shortest.  All pieces of one length move together: a
    successor search finds the smallest gap that holds the length, the pieces and the sequences with
    that gap meet by rank, as many a sequence as fit, and their gaps shrink; the rest of the pieces go
    to the next gap, or to new sequences when there is none.  Equal lengths and equal gaps are kept as
    runs, so a step costs the number of different sizes, never the number of documents, and the result
    is that of best-fit decreasing on single pieces.
    """
    gaps: list[int] = []  # sorted; runs[g]: sequences with that gap, as (first sequence, how many)
    runs: dict[int, list[tuple[int, int]]] = {}
    placed, sequences = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = gap // length
            full = min(n, left // each)
            if full:
                placed.append((length, rank, first, each, capacity - gap))
                add(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than fill one sequence
                placed.append((length, rank, first + full, left, capacity - gap))
                add(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(gap, first + full, n - full)
    return placed


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = SEQUENCE_TOKENS, keep_ids: bool = False) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its place: sequence_id and offset, gapless from 0.

    Null and empty texts are the end id alone; repeated rows are packed each; null ids are packed like
    others; a document longer than a sequence is cut into full pieces and a rest; an empty table gives
    an empty one; other columns are ignored.  Texts are never shuffled.  The driver sees how many
    pieces there are of each length, at most ``capacity`` numbers; ranks within a length are dealt out
    in slices, since most pieces may have one length.
    """
    pieces = cut(token_pieces(pick(docs, "doc_id", "text"), vocabulary, capacity, keep_ids))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(best_fit_runs(counts, capacity))
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())  # pieces are in files by now, and rows keep their numbers
    ranked = running_totals(numbered, ["length"], ["_row"], ["doc_id", "piece", "ids_crc32"], None, slice_count(sum(counts.values())), "rank").drop("_row")
    # the runs of a length start at ascending ranks; (length, rank) as one number finds a piece's run
    table = docs.sparkSession.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 5))
    names = [f.name for f in pieces.schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first_rank, first, each, offset = table.value.T
        starts = (length << 48) | first_rank
        for b in batches:
            size, rank = (b.column(n).to_numpy().astype(np.int64) for n in ("length", "rank"))
            run = np.searchsorted(starts, (size << 48) | rank, side="right") - 1
            nth = rank - first_rank[run]
            columns = [b.column(n) for n in names] + [pa.array(first[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * size)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long").withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian 32-bit) from pack(keep_ids=True); a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
