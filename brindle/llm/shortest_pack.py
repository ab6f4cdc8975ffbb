"""Operator 12: shortest-pack-first packing over the histogram of lengths, without padding to speak of.

Documents stay whole as far as they can: their lengths are packed as a histogram.  Every eighth document of a
task may be cut; these fill what the packs leave open, and go on in sequences of their own.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, shared_path
from .tokens import id_bytes, id_encoder

VOCABULARY = "word_bpe_49k.json"
SEQUENCE_TOKENS, END_ID = 4096, 2
#: One in so many documents of a task may be cut anywhere; 1: all may.
CUT_ONE_IN = 8
_NAMES = ["doc_id", "part", "class", "nth", "start", "length", "ids_crc32", "doc_tokens", "ids"]
#: Output rows that a task holds at once.
_ROWS = 20_000


def _encoded(docs: DataFrame, vocabulary: str, capacity: int, cut_one_in: int) -> DataFrame:
    """Rows of documents that may be cut (class 0, with their ids) and of the pieces of others (class: the length).

    nth: how many of the class, or how many tokens of class 0, the task has had before.
    """
    end = id_bytes([END_ID])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, part, before, docs_seen = id_encoder(vocabulary), TaskContext.get().partitionId(), Counter(), 0
        kind = _stored(lib.library.get_vocab_size())
        for b in batches:
            every, starts = lib.batch_ids(b.column(1))
            every, places = memoryview(every).cast("B"), (4 * starts).tolist()
            rows: list[tuple] = []
            for i, (first, last) in enumerate(zip(places, places[1:])):
                data = bytes(every[first:last]) + end
                n = len(data) // 4
                if docs_seen % cut_one_in == 0:
                    rows.append((i, 0, before[0], 0, n, None, n, np.frombuffer(data, "<u4").astype(kind).tobytes()))
                    before[0] += n
                else:
                    for at in range(0, n, capacity):
                        some = data[4 * at : 4 * (at + capacity)]
                        size = len(some) // 4
                        rows.append((i, size, before[size], at, size, zlib.crc32(some), n, None))
                        before[size] += 1
                docs_seen += 1
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(columns[0], pa.int64())), pa.array([part] * len(rows), pa.int32()), *[pa.array(c,
                    pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.binary())], _NAMES
            )
        lib.forget()

    return docs.mapInArrow(work,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, class long, nth long, start long, length long, ids_crc32 long, doc_tokens long, "
        f"ids binary")


def _stored(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def shortest_first(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Packs ``counts`` pieces of each length: runs of equal placements, what stays open, and the number of sequences.

    Lengths go longest first.  A piece goes to the shortest pack, the one with most room; if even that has too
    little, a new pack opens.  Packs of the same room move together, so that a step costs the number of different
    packs, whatever the number of documents, and gives what pieces placed one by one would.

    Runs: (length, first rank, first sequence, pieces a sequence, offset).  Open: (room, first sequence, sequences).
    """
    rooms: list[int] = []  # sorted
    packs: dict[int, list[tuple[int, int]]] = {}
    placed, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            if room not in packs:
                packs[room] = []
                bisect.insort(rooms, room)
            packs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                first, n = packs[room].pop()
                if not packs[room]:
                    del packs[room]
                    rooms.pop()
                used = min(n, left)
                placed.append((length, rank, first, 1, capacity - room))
                put(room - length, first, used)
                put(room, first + used, n - used)
            else:
                each = capacity // length
                used, first = left // each * each, sequences
                if used:
                    placed.append((length, rank, first, each, 0))
                    put(capacity - each * length, first, used // each)
                if used < left:
                    placed.append((length, rank + used, first + used // each, left - used, 0))
                    put(capacity - (left - used) * length, first + used // each, 1)
                sequences, used = first + -(-left // each), left
            rank, left = rank + used, left - used
    return placed, [(room, *run) for room in rooms for run in packs[room]], sequences


def openings(rooms: list[tuple[int, int, int]], sequences: int, tokens: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """Where ``tokens`` tokens in a row go: (tokens before, first sequence, tokens a sequence, offset) of runs of sequences.

    First the room in packs, least room first; then new full sequences, and for the rest sequences of falling
    powers of two, which need no padding.  A pack that ends at a power of two is left as it is.
    """
    out, before = [], 0
    for room, first, n in rooms:
        used = capacity - room
        if room and used & (used - 1):
            out.append((before, first, room, used))
            before += room * n
    if tokens > before:
        full, rest = divmod(tokens - before, capacity)
        if full:
            out.append((before, sequences, capacity, 0))
            before, sequences = before + full * capacity, sequences + full
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                out.append((before, sequences, 1 << bit, 0))
                before, sequences = before + (1 << bit), sequences + 1
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = SEQUENCE_TOKENS, cut_one_in: int = CUT_ONE_IN) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its place: sequence_id and offset, gapless from 0.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A null or empty text is the end id
    alone; repeated rows, null and repeated ids are packed each, with ids of any type; an empty table gives an empty
    one; other columns are ignored.  A document longer than a sequence is cut into full pieces and a rest; one that
    may be cut is cut where a sequence is full.  Padding stays only if the documents that may be cut hold fewer
    tokens than the others' packs leave open.

    Texts are never shuffled; of an eighth of the documents the ids are, 2 bytes each.  The driver sees the
    histogram, ``capacity`` numbers at most, and the runs of placements, which depend on the lengths that occur
    and not on the number of documents.  A piece's rank in its length is its place in its task and the pieces of that
    length in the tasks before, so no task sees a whole length.
    """
    docs = pick(docs, "doc_id", "text")
    spark = docs.sparkSession
    path = shared_path(spark, "pieces")
    _encoded(docs, vocabulary, capacity, cut_one_in).write.parquet(path)
    pieces = spark.read.parquet(path)
    amount = F.when(F.col("class") == 0, F.col("length")).otherwise(1)
    parts = pieces.groupBy("part", "class").agg(F.sum(amount).alias("n"))
    counts = {r["class"]: r.n for r in parts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    loose = counts.pop(0, 0)
    runs, rooms, sequences = shortest_first(counts, capacity)
    holes = openings(rooms, sequences, loose, capacity)
    table = spark.sparkContext.broadcast([np.array(sorted(x), dtype=np.int64).reshape(-1, n) for x, n in ((runs, 5), (holes, 4))])
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "class"]).select("doc_id", "class", (F.col("first") + F.col("nth")).alias("rank"), "start", "length", "ids_crc32", "doc_tokens", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (length, first_rank, first, each, offset), holes = table.value[0].T, table.value[1]
        starts, kind = (length << 48) | first_rank, _stored(id_encoder(vocabulary).library.get_vocab_size())
        for b in batches:
            size, rank, at = (b.column(n).to_numpy() for n in ("class", "rank", "start"))
            whole = np.flatnonzero(size)
            size, rank = size[whole], rank[whole]
            run = np.searchsorted(starts, (size << 48) | rank, side="right") - 1
            nth = rank - first_rank[run]
            rows = pa.array(whole)
            kept = [b.column(n).take(rows) for n in names[:5]] + [pa.array(first[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * size)]
            yield pa.RecordBatch.from_arrays(kept, names)
            rows, places = [], []
            for i in np.flatnonzero(b.column("class").to_numpy() == 0).tolist():
                ids = np.frombuffer(b.column("ids")[i].as_py(), kind).astype("<u4")
                for place in _filled(ids, b.column("rank")[i].as_py(), holes):
                    rows.append(i)
                    places.append(place)
                    if len(rows) == _ROWS:
                        yield _cut_rows(b, rows, places, names)
                        rows, places = [], []
            yield _cut_rows(b, rows, places, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _filled(ids: np.ndarray, at: int, holes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, length, ids_crc32, sequence, offset) of the pieces of a document whose first id is token ``at`` of those that may be cut."""
    data, start = memoryview(ids).cast("B"), 0
    hole = int(np.searchsorted(holes[:, 0], at, side="right")) - 1
    while start < len(ids):
        if hole + 1 < len(holes) and at >= holes[hole + 1, 0]:
            hole += 1
        before, first, room, offset = holes[hole].tolist()
        nth, used = divmod(at - before, room)
        n = min(room - used, len(ids) - start)
        yield start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), first + nth, offset + used
        start, at = start + n, at + n


def _cut_rows(b: pa.RecordBatch, rows: list[int], places: list[tuple], names: list[str]) -> pa.RecordBatch:
    start, length, crc, sequence, offset = (pa.array(c, pa.int64()) for c in (zip(*places) if places else [()] * 5))
    taken = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(taken), start, length, crc, b.column("doc_tokens").take(taken), sequence, offset], names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
