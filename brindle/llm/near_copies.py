"""Operator 7 where texts, not fingerprints, are compared: word shingles with a Jaccard similarity of 0.8 or more.

Candidates are told by SimHash fingerprints and meet, where these differ too much, in bands of a MinHash signature; every
link is checked on the whole shingle sets.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, give_back, shared_path, with_row_keys
from .graph import connected, first_rows

SHINGLE_WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: A pair of similarity s meets in a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9997 at 0.8.
BANDS, ROWS = 20, 5
#: Texts of a band that one task takes in; of larger bands, each two slices of half as many meet.
TOGETHER = 8192
#: Keys of rows that may be broadcast.
SENT_KEYS = 500_000
_KEYS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64) | np.array([[0], [1]], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of so many words; a shorter text is one run, an empty one has none."""
    w = text.encode().translate(LOWER).split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    n = max(1, len(w) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[-n:] - 1).tolist())], dtype=np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS hashes for each set, none of which is empty."""
    firsts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for i in range(BANDS * ROWS):
        x = np.minimum.reduceat((every ^ _KEYS[0, i]) * _KEYS[1, i], firsts)
        band = out[:, i // ROWS]
        band ^= x + np.uint64(i)
        band *= _MIX
        band ^= band >> np.uint64(29)
    return out


def fingerprint(own: np.ndarray) -> np.int64:
    """SimHash of a set of shingles: a bit is set if it is in over half the hashes."""
    ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own)).view(np.int64)[0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values; of two empty ones 1."""
    either = len(a) + len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (either - both) if either else 1.0


def _shingled(keyed: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2, point (a 128-bit hash of the shingle set), size, shingles (32-bit hashes), bands and fp (SimHash) of each row."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "k1", "k2", "point", "size", "shingles", "bands", "fp"]

    def lists(parts: list[np.ndarray], kind: type) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(kind)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                sets = [shingles(t.as_py() or "", words) for t in some.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                banded = [np.zeros(0, dtype=np.uint64)] * len(sets)
                if full:
                    for i, row in zip(full, bands([sets[i] for i in full])):
                        banded[i] = row
                points = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                # half the bits are enough to compare two texts: of 20,000 words each they share a tenth of one by chance
                short = [np.unique(s >> np.uint64(32)).astype(np.uint32) for s in sets]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), points, pa.array([len(s) for s in sets],
                    pa.int64()), lists(short, np.int32), lists(banded, np.int64), pa.array([fingerprint(s) for s in sets], pa.int64())], names)
        give_back()

    return keyed.mapInArrow(work, f"doc_id {kind}, k1 long, k2 long, point binary, size long, shingles array<int>, bands array<long>, fp long")


class Neighbours:
    """Texts of a band that have come so far, and which of them are joined.

    Some are pivots; each other text lies with a pivot that it is like.  As one less similarity is a metric, a text
    at some distance from a pivot can only be like those of its texts that are nearly as far, and only these are
    looked at, until one joins it to the pivot's group.  So every pair that is alike ends in one group, though few are compared.
    """

    def __init__(self, least: float):
        self.reach = 1 - least + 1e-9
        self.least, self.sets, self.points, self.parent = least, [], [], []
        self.pivots: list[tuple[int, list[tuple[float, int]]]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, point: bytes, own: np.ndarray) -> list[bytes]:
        """Takes a text in; of each group that it is like, a text that shows it."""
        new = len(self.sets)
        self.sets.append(own)
        self.points.append(point)
        self.parent.append(new)
        links, place = [], None
        for pivot, others in self.pivots:
            other = self.sets[pivot]
            joined = self.root(pivot) == self.root(new)
            farthest = others[-1][0] if others else 0.0
            if place is not None and joined or min(len(own), len(other)) < (1 - self.reach - farthest) * max(len(own), len(other)):
                continue
            alike = similarity(other, own)
            if alike >= self.least:
                found = pivot
                place = place or (others, 1 - alike)
            elif joined:
                continue
            else:
                first = bisect_left(others, (1 - alike - self.reach, -1))
                found = next((i for _, i in others[first:] if similarity(self.sets[i], own) >= self.least), None)
            if found is not None and not joined:
                links.append(self.points[found])
                self.parent[self.root(pivot)] = self.root(new)
        if place:
            insort(place[0], (place[1], new))
        else:
            self.pivots.append((new, []))
        return links


def _linked(met: DataFrame, least: float) -> DataFrame:
    """(a, b) of ``met(group, point, shingles)``, sorted by group: links between texts that are alike, as few as join them.

    A group of n texts gives n - 1 links at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near = None, None
        for b in batches:
            found = []
            for i, (group, point) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if group != now:
                    now, near = group, Neighbours(least)
                found += [(p, point) for p in near.add(point, b.column(2)[i].values.to_numpy().copy())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])
        give_back()

    return met.mapInArrow(work, "a binary, b binary")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies in ``docs``, in all its columns: that of the smallest doc_id, null last.

    Groups are chains of links between texts whose shingle sets are ``least`` alike or more.  Candidates are texts whose
    SimHash fingerprints lie within operator 7's threshold, found by its anchors, and, as texts just alike enough differ
    in more bits than anchors reach, those that share a band.  Of texts that share a fingerprint's chain or a
    band no link is lost; bands where the same texts meet are looked at once, and a band of more than TOGETHER texts
    is split into slices, each two of which meet in a task.
    Null texts, and texts without a word, are copies of one another; equal texts too, however many.
    """
    from .simhash import links

    spark = docs.sparkSession
    plain, keyed = with_row_keys(docs)
    path = shared_path(spark, "bands")
    _shingled(keyed, words).drop("shingles").write.parquet(path)
    rows = spark.read.parquet(path)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "point", "k1", "k2")
    points = cut(rows.select("point", "bands", "fp", first.alias("first")).groupBy("point").agg(F.min("first").alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    # fingerprints within operator 7's few bits, by its anchors, and chains of them: one more band
    roots = connected(links(points.where(F.size("bands") > 0).select("fp").distinct())).withColumnRenamed("node", "fp")
    alike = points.where(F.size("bands") > 0).join(roots, "fp", "left").withColumn("band", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")))
    sent = points.select("point", "first", F.explode("bands").alias("band")).union(alike.select("point", "first", "band"))
    # a set of texts is told by how many they are and two sums of their hashes
    sums = [F.sum(F.xxhash64(F.lit(i), "point").cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    shared = sent.groupBy("band").agg(F.count("*").alias("n"), *sums).where("n > 1").groupBy("n", "h1", "h2").agg(F.min("band").alias("band"))
    half = TOGETHER // 2
    sliced = shared.select("band", F.when(F.col("n") > TOGETHER, F.ceil(F.col("n") / half)).otherwise(1).cast("int").alias("slices"))
    met = cut(sent.join(sliced, "band").withColumn("own", F.pmod(F.xxhash64("point"), "slices").cast("int")))
    # the sets are several times the texts: they are made again, for candidates alone
    named = met.select("first.k1", "first.k2").distinct()
    sets = _shingled(keyed.join(named, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc_id", "text", "k1", "k2"), words).select("point", "shingles")
    group = F.concat_ws(":", F.col("band").cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    # slices that meet another one meet themselves there
    others = F.when(F.col("slices") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: i != F.col("own")))
    grouped = met.withColumn("other", F.explode(others)).select(group.alias("group"), "point", "first")
    sorted_bands = grouped.join(sets, "point").repartition("group").sortWithinPartitions("group", "first").select("group", "point", "shingles")
    kept = cut(first_rows(points.select("point", "first"), _linked(sorted_bands, least).distinct()))
    return _only(plain, rows.select("k1", "k2"), kept).drop("k1", "k2").toDF(*docs.columns)


def _only(plain: DataFrame, keys: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``plain`` for each of the keys ``kept``; ``keys`` are those of all rows.

    Where few keys go, or are on several rows (SENT_KEYS at most, 16 bytes each), these are sent to the rows, and
    the texts stay where they are; else rows and keys meet by shuffling them.
    """
    both = ["k1", "k2"]
    changed = keys.groupBy(*both).agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), both, "left")
    changed = cut(changed.where("kept is null or n > 1").select(*both, F.col("kept").isNull().alias("gone")))
    if changed.count() > SENT_KEYS:
        return plain.join(kept, both, "left_semi").dropDuplicates(both)
    marked = plain.join(F.broadcast(changed), both, "left")
    return marked.where("gone is null").drop("gone").unionByName(marked.where("not gone").drop("gone").dropDuplicates(both))
