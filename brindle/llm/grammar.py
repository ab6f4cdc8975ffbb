"""Operator 4: token-id files compressed by a Re-Pair grammar for each shard, with random access."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, pick, shared_path
from .tokens import id_bytes, id_encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Tokens of a shard, and how often a pair must occur to become a rule: there is no other end.
SHARD_TOKENS, LEAST = 1 << 21, 8
#: A round takes the pairs that are within this share of the most frequent one; where it changes less than SMALL of
#: the symbols, the next ones look only around what has changed.
SHARE, SMALL = 64, 0.02
#: Every so many symbols of a shard have their token place stored.
SAMPLE = 4096
_LOW = np.uint64(0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX32, _MIXED = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@dataclass
class Shard:
    """A shard's grammar: terminals are ids below ``terminals``, rule i is the symbol terminals + i, lengths[i] tokens long."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def sizes(self, some: np.ndarray) -> np.ndarray:
        """Tokens that symbols expand to."""
        rule = some >= self.terminals
        out = np.ones(len(some), dtype=np.int64)
        out[rule] = self.lengths[some[rule] - self.terminals]
        return out

    def decode(self) -> np.ndarray:
        """All ids.  Rules are expanded level by level, each from those below it."""
        level: list[int] = []
        deep = [0] * self.terminals
        for a, b in zip(self.left.tolist(), self.right.tolist()):
            level.append(1 + max(deep[a], deep[b]))
            deep.append(level[-1])
        order = np.argsort(level, kind="stable")
        long = self.lengths.astype(np.int64)
        starts = np.zeros(len(long), dtype=np.int64)
        starts[order] = np.cumsum(long[order]) - long[order]
        flat = np.zeros(int(long.sum()) + 1, dtype=np.uint32)

        def expanded(some: np.ndarray) -> np.ndarray:
            n = self.sizes(some)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            symbol = np.repeat(some, n)
            rule = symbol >= self.terminals
            symbol[rule] = flat[starts[symbol[rule] - self.terminals] + place[rule]]
            return symbol

        at = 0
        for rules in np.split(order, np.flatnonzero(np.diff(np.array(level)[order])) + 1) if len(order) else ():
            ids = expanded(np.stack([self.left[rules], self.right[rules]], axis=1).ravel())
            flat[at : at + len(ids)] = ids
            at += len(ids)
        return expanded(self.symbols)

    def between(self, symbols: np.ndarray, skip: int, n: int) -> tuple[list[int], int]:
        """``n`` ids behind the first ``skip`` that ``symbols`` expand to, and how many rules had to be opened.

        A symbol before or behind the wanted ids is passed by its length; only those that hold some are opened.
        """
        ids, opened = [], 0
        waiting = symbols[::-1].tolist()
        while waiting and len(ids) < n:
            symbol = waiting.pop()
            if symbol < self.terminals:
                if skip:
                    skip -= 1
                else:
                    ids.append(symbol)
            elif skip >= int(self.lengths[symbol - self.terminals]):
                skip -= int(self.lengths[symbol - self.terminals])
            else:
                opened += 1
                waiting += (int(self.right[symbol - self.terminals]), int(self.left[symbol - self.terminals]))
        return ids, opened


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each can be replaced; of a run of one symbol, every other pair."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    times, pairs = np.diff(np.append(first, len(ordered))), ordered[first]
    return pairs, np.where(pairs >> np.uint64(32) == pairs & _LOW, (times + 1) // 2, times)


def _keys(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pairs of symbols at those places."""
    keys = seq[at].astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= seq[at + 1]
    return keys


def _frequent(seq: np.ndarray, least: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all pairs that can be within ``share`` of the most frequent one, the pairs there, these in order and their numbers.

    Pairs fall into slots by a hash, and a slot that is met too seldom holds no frequent pair, so that few are sorted.
    """
    bits = max(12, len(seq).bit_length() - 2)
    slots = seq[:-1] * _MIX32
    slots ^= seq[1:] * _MIXED
    slots >>= np.uint32(max(0, 32 - bits))
    met = np.bincount(slots)
    bar = max(least, int(met.max()) // share)
    while True:
        at = np.flatnonzero((met >= bar)[slots])
        keys = _keys(seq, at)
        pairs, times = _counted(keys) if len(at) else (keys, np.zeros(0, dtype=np.int64))
        wanted = max(least, int(times.max(initial=0)) // share)
        if wanted >= bar:
            return at, keys, pairs, times
        bar = wanted  # several pairs in the fullest slot, or a run, whose pairs count half


def _places_of(pairs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys are among the pairs (distinct, in order), and which pair it is each time; by a hash table."""
    bits = np.uint64(64 - max(12, len(pairs).bit_length() + 3))
    slots = (pairs * _MIX) >> bits
    owner = np.full(1 << (64 - int(bits)), -1, dtype=np.int32)
    owner[slots] = np.arange(len(pairs))
    pair = owner[(keys * _MIX) >> bits]
    found = np.flatnonzero(pair >= 0)
    pair = pair[found].astype(np.int64)
    other = np.flatnonzero(pairs[pair] != keys[found])
    put_out = np.flatnonzero(owner[slots] != np.arange(len(pairs)))  # pairs that another has put out of their slot
    known = np.ones(len(found), dtype=bool)
    known[other] = False
    if len(put_out):
        at = np.minimum(np.searchsorted(pairs[put_out], keys[found[other]]), len(put_out) - 1)
        pair[other] = put_out[at]
        known[other] = pairs[put_out[at]] == keys[found[other]]
    return found[known], pair[known]


def _winners(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which occurrences are replaced: of two that share a symbol the one of the more frequent pair, in a run of one pair every other."""
    touch = places[1:] == places[:-1] + 1
    lost = np.zeros(len(places), dtype=bool)
    lost[1:] |= touch & (rank[:-1] < rank[1:])
    lost[:-1] |= touch & (rank[1:] < rank[:-1])
    same = np.concatenate(([False], touch & (rank[:-1] == rank[1:])))
    if same.any():
        nth = np.arange(len(places))
        lost |= (nth - np.maximum.accumulate(np.where(same, 0, nth))) & 1 == 1
    return ~lost


def compress(ids: np.ndarray, terminals: int, least: int = LEAST) -> Shard:
    """Re-Pair: frequent pairs become rules until no pair occurs ``least`` times.

    A round takes the most frequent pairs together (SHARE), with those of equal symbols among them; where two
    occurrences overlap, the more frequent pair has its way, as it would have, coming first.  After a round
    that changed little, only the pairs around new symbols are counted, for they alone can have become
    frequent; the end is always a count of all.
    """
    seq, left, right, lengths = ids.astype(np.uint32), [], [], []
    size, share, near = terminals, SHARE, None
    long = np.ones(terminals, dtype=np.int64)
    while len(seq) > 1:
        if near is None:
            at, keys, pairs, times = _frequent(seq, least, share)
        else:
            at, keys = near, _keys(seq, near)
            pairs, times = _counted(keys)
        most = int(times.max(initial=0))
        if most < least:
            if near is None:
                break
            near = None
            continue
        frequent = times >= max(least, most // share)
        pairs, times = pairs[frequent], times[frequent]
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(pairs))
        found, pair = _places_of(pairs, keys)
        places = at[found]
        won = _winners(places, rank[pair])
        kept = np.bincount(pair[won], minlength=len(pairs))
        made = kept >= least
        if not made.any():  # each loses to others too often: the one that loses least
            made = kept == kept.max()
        symbol = np.cumsum(made) - 1 + size
        hit = won & made[pair]
        new, passed = places[hit], places[~hit]
        seq[new] = symbol[pair[hit]]
        stay = np.ones(len(seq), dtype=bool)
        stay[new + 1] = False
        seq = seq[stay]
        if len(new) < SMALL * len(seq):
            passed = passed[stay[passed]]
            around = np.arange(len(new))  # a new symbol's place: each one before it took one away
            near = np.unique(np.concatenate((new - around, new - around - 1, passed - np.searchsorted(new + 1, passed))))
            near, share = near[(near >= 0) & (near < len(seq) - 1)], len(ids)
        else:
            near = None
        left.append((pairs[made] >> np.uint64(32)).astype(np.uint32))
        right.append((pairs[made] & _LOW).astype(np.uint32))
        lengths.append(long[left[-1]] + long[right[-1]])
        long = np.concatenate((long, lengths[-1]))
        size += int(made.sum())

    def whole(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, dtype=np.uint32)

    return Shard(terminals, whole(left), whole(right), whole(lengths), seq)


_FORMAT = "part int, seq int, terminals int, rules binary, lengths binary, symbols_low binary, symbols_high binary, samples binary, doc_ids binary, null_ids binary, doc_starts binary, n_tokens long"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("terminals", pa.int32())] + [(n, pa.binary()) for n in ("rules", "lengths",
    "symbols_low", "symbols_high", "samples", "doc_ids", "null_ids", "doc_starts")] + [("n_tokens", pa.int64())])


def _record(part: int, seq: int, terminals: int, docs: list, ends: list[int], data: list[bytes]) -> dict:
    """One shard as a row of the files: rules with the lengths of their expansions, symbols as 16 low and 8 high bits."""
    ids = np.frombuffer(b"".join(data), dtype="<u4")
    shard = compress(ids, terminals)
    if terminals + len(shard.left) > 1 << 24:
        raise ValueError("more symbols than 24 bits hold: make shards smaller")
    samples = np.concatenate(([0], np.cumsum(shard.sizes(shard.symbols))))[::SAMPLE]
    return {
        "part": part, "seq": seq, "terminals": terminals, "rules": np.stack([shard.left, shard.right]).astype("<u4").tobytes(), "lengths": shard.lengths.astype("<u4").tobytes(),
        "symbols_low": (shard.symbols & 0xFFFF).astype("<u2").tobytes(), "symbols_high": (shard.symbols >> 16).astype(np.uint8).tobytes(),
        "samples": samples.astype("<i8").tobytes(), "doc_ids": np.array([d or 0 for d in docs], dtype="<i8").tobytes(), "null_ids": bytes(d is None for d in docs),
        "doc_starts": np.array([0, *ends], dtype="<i8").tobytes(), "n_tokens": len(ids),
    }


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of every row of ``docs(doc_id, text)``, each with the end id, in ascending order of doc_id.

    Ids are whole numbers that fit a long.  A null text is an empty one; null ids come first; equal ids are ordered by text.  Shards follow one
    another by (part, seq); each has its rules, its symbols, the token place of every SAMPLE-th symbol, and its
    documents' ids and places.  A file is committed by Spark's writer, so a lost task is written again.
    """
    # rows of one id, or without one, may be most: their texts' beginnings part them
    ranges = pick(docs, "doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 32))
    ordered = ranges.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = id_encoder(vocabulary)
        terminals, end = lib.library.get_vocab_size(), id_bytes([END_ID])
        docs, ends, data, total, seq, part = [], [], [], 0, 0, 0
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            ids, starts = lib.batch_ids(b.column(1))
            every, places = memoryview(ids).cast("B"), (4 * starts).tolist()
            for doc, first, last in zip(b.column(0).to_pylist(), places, places[1:]):
                data.append(bytes(every[first:last]) + end)
                total += len(data[-1]) // 4
                docs.append(doc)
                ends.append(total)
                if total >= shard_tokens:
                    yield pa.RecordBatch.from_pylist([_record(part, seq, terminals, docs, ends, data)], _ARROW)
                    docs, ends, data, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield pa.RecordBatch.from_pylist([_record(part, seq, terminals, docs, ends, data)], _ARROW)
        give_back()  # the worker keeps its cache for the next task, which meets the same frequent words

    ordered.mapInArrow(work, _FORMAT).write.option("compression", "zstd").parquet(path)


def _shard(row: dict) -> Shard:
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(2, -1)
    symbols = np.frombuffer(row["symbols_low"], dtype="<u2").astype(np.uint32) | np.frombuffer(row["symbols_high"], dtype=np.uint8).astype(np.uint32) << np.uint32(16)
    return Shard(row["terminals"], rules[0], rules[1], np.frombuffer(row["lengths"], dtype="<u4"), symbols)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, and first, the ids of all shards before; from the files' counts alone.

    Parts are added up before shards, so no task sees more than one part's shards or one number a part.
    """
    shards = spark.read.schema(_FORMAT).parquet(path).select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(parts, "part").select("part", "seq",
        (F.col("part_first") + F.col("inner")).alias("first"))


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """part, seq, doc_id, inner (its place in the shard), n_tokens, ids_crc32 (and ids) of every document in the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                data = memoryview(_shard(row).decode().astype("<u4").tobytes())
                starts = np.frombuffer(row["doc_starts"], dtype="<i8")
                docs = np.frombuffer(row["doc_ids"], dtype="<i8")
                n = len(docs)
                at = starts.tolist()
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(at, at[1:])]
                columns = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(docs,
                    mask=np.frombuffer(row["null_ids"], dtype=np.uint8).astype(bool)), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(data[4 * a : 4 * z]) for a, z in zip(at, at[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    return spark.read.schema(_FORMAT).parquet(path).mapInArrow(work, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def tokens_at(row: dict, start: int, n: int) -> np.ndarray:
    """``n`` ids from place ``start`` of a shard (a row of the files as a dict).

    The samples give a symbol shortly before; from there the stored lengths lead on, and only rules that
    hold wanted ids are opened.
    """
    shard, samples = _shard(row), np.frombuffer(row["samples"], dtype="<i8")
    first = int(np.searchsorted(samples, start, side="right") - 1)
    last = int(np.searchsorted(samples, start + n, side="left"))
    ids, _ = shard.between(shard.symbols[first * SAMPLE : last * SAMPLE], start - int(samples[first]), n)
    return np.array(ids, dtype=np.uint32)


def stored_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return read_tokens(spark, path).join(shard_starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return stored_tokens(spark, path)
