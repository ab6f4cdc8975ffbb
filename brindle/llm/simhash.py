"""Operator 7: SimHash near-duplicates, linked through the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import LOWER, cut, give_back, pick, with_row_keys
from .graph import connected, first_rows

SHINGLE_WORDS, SEED, THRESHOLD = 3, 42, 2
#: The places of the code's blocks in a fingerprint as (first bit, bits, generator polynomial, errors
#: corrected): two binary Golay codes and a Hamming code, all perfect.  The last three bits are in no block.
BLOCKS = ((0, 23, 0b110001110101, 3), (23, 23, 0b110001110101, 3), (46, 15, 0b10011, 1))
#: Shingles whose bits are unpacked at once, and the share of rows from which a fingerprint is joined on its own.
BITS_AT_ONCE, HOT_SHARE = 100_000, 10_000


def _digests(words: list[bytes], first: int, last: int) -> np.ndarray:
    """Hashes of the shingles that begin at words ``first`` to before ``last``."""
    line = b" ".join(words[first : last + SHINGLE_WORDS - 1])
    ends = np.cumsum(np.fromiter(map(len, words[first : last + SHINGLE_WORDS - 1]), np.int64) + 1) - 1
    starts = np.concatenate(([0], ends[: last - first - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:z], SEED) for a, z in zip(starts, ends[-(last - first) :].tolist())], dtype=">u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints_of(texts: list[str], size: int = BITS_AT_ONCE) -> np.ndarray:
    """SimHash of each text, unsigned 64 bits; bits are added up for ``size`` shingles at a time, of a text or of many."""
    out = np.zeros(len(texts), dtype=np.uint64)
    rows, held, counts = [], [], []

    def add_up() -> None:
        if rows:
            n = np.array(counts)
            bits = np.unpackbits(np.concatenate(held).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
            out[rows] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
            for x in (rows, held, counts):
                x.clear()

    waiting = 0
    for i, text in enumerate(texts):
        words = text.encode().translate(LOWER).split()
        n = len(words) - SHINGLE_WORDS + 1 if len(words) > SHINGLE_WORDS else min(len(words), 1)
        if n > size:
            ones = sum(_ones(_digests(words, at, min(at + size, n))) for at in range(0, n, size))
            out[i] = np.packbits(2 * ones > n).view(">u8")[0]
        elif n:
            if waiting + n > size:
                add_up()
                waiting = 0
            rows.append(i)
            hashes = _digests(words, 0, n) if n > 1 else np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=">u8")
            held.append(hashes.view(np.uint8))  # as bytes: joined numbers would lose their byte order
            counts.append(n)
            waiting += n
    add_up()
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of ``docs(doc_id, text, ...)``, then its other columns."""
    others = docs.schema.fields[2:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprints_of([t.as_py() or "" for t in b.column(1).slice(at, 500)]) for at in range(0, b.num_rows, 500)]
            fps = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *[f.name for f in others]])
        give_back()

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long{kinds}")


@cache
def _decoder(bits: int, generator: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 8-bit parts of a word, and the error pattern of each syndrome."""
    check = generator.bit_length() - 1
    remainders = []
    for i in range(bits):
        r = 1 << i
        while r.bit_length() > check:
            r ^= generator << (r.bit_length() - 1 - check)
        remainders.append(r)
    part = np.zeros((-(-bits // 8), 256), dtype=np.int64)
    for i, r in enumerate(remainders):
        part[i // 8, (np.arange(256) >> (i % 8)) & 1 == 1] ^= r
    errors = np.zeros(1 << check, dtype=np.int64)
    for w in range(1, radius + 1):
        for places in combinations(range(bits), w):
            s = 0
            for p in places:
                s ^= remainders[p]
            errors[s] = sum(1 << p for p in places)
    return part, errors


def _nearest(words: np.ndarray, block: tuple[int, int, int, int]) -> np.ndarray:
    """The codeword within the code's radius; a perfect code has just one."""
    part, errors = _decoder(*block[1:])
    syndrome = part[0][words & 255]
    for i in range(1, len(part)):
        syndrome = syndrome ^ part[i][(words >> (8 * i)) & 255]
    return words ^ errors[syndrome]


def meetings(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, points): the anchors that each fingerprint is sent to, each once, and its points there.

    An anchor is a word of the direct sum of BLOCKS; every point lies within radius 3 + 3 + 1 of its own.
    Two fingerprints that differ in at most THRESHOLD = 2 bits have a point within one bit of both, so
    they share that point's anchor: each goes to the anchors within the radius plus its half of the
    threshold that can be such a point's.  ``points`` has bit i where flipping bit i gives a point of the
    anchor; a fingerprint is itself a point of its own, the first.
    """
    words = [(fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits, _, _ in BLOCKS]
    own = [_nearest(w, b) for w, b in zip(words, BLOCKS)]
    base = sum(o << b[0] for o, b in zip(own, BLOCKS))
    home = np.full(len(fps), 0b111 << 61, dtype=np.uint64)  # flips of the bits outside the blocks keep the anchor
    rows, anchors, points = [], [], []
    for w, o, b in zip(words, own, BLOCKS):
        near = _nearest(w[:, None] ^ (1 << np.arange(b[1])), b)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        flips = np.uint64(1) << (order + b[0]).astype(np.uint64)
        found = np.bitwise_or.reduceat(flips.ravel(), np.flatnonzero(new)) if len(fps) else flips.ravel()
        r, c = np.nonzero(new)
        mine = near[r, c] == o[r]
        home[r[mine]] |= found[mine]
        r, c, found = r[~mine], c[~mine], found[~mine]
        rows.append(r)
        anchors.append(base[r] ^ ((o[r] ^ near[r, c]) << b[0]))
        points.append(found)
    return np.concatenate([np.arange(len(fps)), *rows]), np.concatenate([base, *anchors]), np.concatenate([home, *points])


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchor of every point within one bit of each fingerprint, each once."""
    return meetings(fps)[:2]


def links(points: DataFrame) -> DataFrame:
    """(a, b): links that join just the distinct fingerprints ``points(fp)`` at most THRESHOLD bits apart, by chains.

    A fingerprint that is alone at an anchor has no link there.  At the others the fingerprints are compared
    by the anchor's points: those within one bit of a point are within two bits of each other, 65 at most,
    so links to the smallest are enough, and no anchor's crowd is ever compared in pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                some = fps[at : at + 20_000]
                rows, anchors, flips = meetings(some)
                own = np.arange(len(rows)) < len(some)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(some[rows]), pa.array(flips.view(np.int64)), pa.array(own)], ["anchor", "fp", "flips", "own"])

    sent = cut(points.mapInArrow(work, "anchor long, fp long, flips long, own boolean"))
    shared = sent.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    met = sent.join(shared, "anchor", "left_semi")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    flipped = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("flips").bitwiseAND(bit(i)) != 0), lambda i: F.col("fp").bitwiseXOR(bit(i)))
    near = F.when(F.col("own"), F.concat(F.array("fp"), flipped)).otherwise(flipped)
    groups = met.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def _meet(rows: DataFrame, named: DataFrame, points: DataFrame) -> DataFrame:
    """``rows`` joined with ``named`` by fp; fingerprints that very many rows have are looked up, not shuffled.

    Such a fingerprint has more than one row in HOT_SHARE of all, so there are HOT_SHARE of them at most.
    """
    total = points.agg(F.sum("n")).first()[0] or 0
    hot = points.where(F.col("n") > max(total / HOT_SHARE, 10_000)).select("fp", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), "fp", "left")
    few = F.broadcast(named.join(hot, "fp", "left_semi"))
    return marked.where("hot is null").drop("hot").join(named, "fp").unionByName(marked.where("hot").drop("hot").join(few, "fp"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs(doc_id, text)``.

    Null and empty texts, and texts of white space, have fingerprint zero and link like others; equal
    texts share a fingerprint; a null id is never a component's name, unless all its ids are null;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    rows = cut(with_fingerprints(pick(docs, "doc_id", "text")))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = connected(links(points.select("fp"))).withColumnRenamed("node", "fp")
    rooted = cut(points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    linked = rooted.where("root <> fp").select("root").distinct()
    names = rooted.join(linked, "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return _meet(rows, named, points).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``components`` with the fingerprint as 16 lower-case hex digits."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int | None = None, least: float | None = None) -> DataFrame:
    """One row of each component of ``docs``, in all its columns: that of the smallest doc_id, null last.

    With ``words`` and ``least``, texts are linked whose shingles of so many words are alike by ``least`` or
    more.  Candidates are those whose fingerprints the anchors link, and, as such texts may differ in some 16 of 64
    bits, which no anchors reach at a bearable number of copies, those that meet in bands of a MinHash signature
    too; whole sets decide (near_copies).

    Else fingerprints within THRESHOLD bits are linked.  A row is told by its id and text, so rows without an id, or with one id and different texts, are
    dropped only for a row of their own component.  Of one id's rows that with the smallest fingerprint
    stays; of rows equal in id and text, any.
    """
    if words is not None and least is not None:
        return near_copies.keep_first(docs, words, least)
    plain, keyed = with_row_keys(docs)
    rows = cut(with_fingerprints(keyed))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "k1", "k2")
    points = cut(rows.groupBy("fp").agg(F.min(first).alias("first")))
    kept = first_rows(points.withColumnRenamed("fp", "point"), links(points.select("fp")))
    return plain.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).drop("k1", "k2").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
