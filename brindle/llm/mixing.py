"""Operator 1: mixing sources to target weights, in blocks of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, pick, running_totals, slice_count

#: Words of a block; blocks of an output shard; blocks whose shares are fixed together; seed; the cap on repeats.
BLOCK_WORDS, SHARD_BLOCKS, GROUP_BLOCKS, SEED, MAX_EPOCHS = 256, 4096, 1 << 26, 17, 3.0
WEIGHTS = (5.0, 2.0, 1.0)
#: Up to so many sources (a few MB) the plan is sent to the tasks, which draw each shard's counts; of more, it stays a
#: table, and each source's slots draw their own shards.
SENT_SOURCES = 100_000
#: Slots of a source that one row of that table stands for; copies of it that rows of documents are dealt to.
RANGE_SLOTS, SALTS = 1 << 16, 16
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = MAX_EPOCHS) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in sorted(free))
        full = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in sorted(full):
            out[i] = most * sizes[i]
            left -= out[i]
        free -= full
    return out


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1, at ``index``: a Feistel network, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.default_rng([key & 0xFFFFFFFF, key >> 32, 5]).integers(0, 1 << 63, 4)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & low
        for k in reversed(keys) if back else keys:
            if back:
                a, b = b ^ (_mixed(a, k) & low), a
            else:
                a, b = b, a ^ (_mixed(b, k) & low)
        return (a << shift) | b

    x = once(np.asarray(index, dtype=np.uint64))
    while (outside := x >= np.uint64(size)).any():
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def pass_key(seed: int, source: int, epoch: int) -> int:
    return (seed << 48) ^ (source << 16) ^ epoch


def blocks_at(slot: np.ndarray, blocks: int, key) -> np.ndarray:
    """The blocks at slots of a source: each run over all its blocks has its own permutation."""
    epoch, inside = np.divmod(slot, blocks)
    out = np.zeros(len(slot), dtype=np.int64)
    for e in np.unique(epoch):
        at = epoch == e
        out[at] = permuted(inside[at], blocks, key(int(e)))
    return out


@dataclass
class Plan:
    """For each source: its words, its target, its blocks, the slots the mix gives it, and the words of its last slot."""

    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    last: np.ndarray
    block: int
    seed: int

    def key(self, source: int, epoch: int) -> int:
        return pass_key(self.seed, source, epoch)

    def block_of(self, source: int, slot: np.ndarray) -> np.ndarray:
        return blocks_at(slot, int(self.blocks[source]), lambda epoch: self.key(source, epoch))


def slots_of(n: int, want: int, block: int, key) -> tuple[int, int]:
    """Slots that just reach ``want`` words of a source of ``n``, and the words of the last one; ``key(epoch)`` permutes its blocks."""
    if not n or not want:
        return 0, 0
    blocks = -(-n // block)
    short = n - (blocks - 1) * block
    epochs, rest = divmod(want, n)
    if not rest:
        epochs, rest = epochs - 1, n
    at = int(permuted(np.array([blocks - 1]), blocks, key(epochs), back=True)[0])  # the short block's turn
    used = -(-rest // block)
    if at < used:
        used = -(-(rest + block - short) // block) if rest > at * block + short else at + 1
    words = used * block - (block - short if at < used else 0)
    return epochs * blocks + used, (short if at == used - 1 else block) - (words - rest)


def make_plan(sizes: list[int], weights: list[float], block: int = BLOCK_WORDS, seed: int = SEED, most: float = MAX_EPOCHS) -> Plan:
    """Slots to just reach each target; the last slot of a source is cut so that its words are the target, rounded."""
    goal = targets(sizes, weights, most)
    size = np.array(sizes, dtype=np.int64)
    plan = Plan(size, np.array(goal), -(-size // block), np.zeros_like(size), np.zeros_like(size), block, seed)
    for s, (n, want) in enumerate(zip(sizes, goal)):
        plan.slots[s], plan.last[s] = slots_of(n, round(want), block, lambda epoch, s=s: plan.key(s, epoch))
    return plan


def shard_table(plan: Plan, per_shard: int = SHARD_BLOCKS, per_group: int = GROUP_BLOCKS) -> tuple[int, np.ndarray]:
    """How many groups there are, and the first shard of each."""
    total = int(plan.slots.sum())
    groups = max(1, -(-total // per_group))
    shards = [0]
    for g in range(groups):
        n = int(((g + 1) * plan.slots // groups - g * plan.slots // groups).sum())
        shards.append(shards[-1] + -(-n // per_shard))
    return groups, np.array(shards)


def draw(plan: Plan, groups: int, first: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of slots each source gets in an output shard, and how many it has had before.

    Multinomial counts for each shard, given that each source's counts add up to its slots: the shards
    of a group are halved again and again, and a draw without replacement tells how many slots of each
    source go to the left half.  A task walks down to its shards alone; no shard waits for another.
    """
    g = int(np.searchsorted(first, shard, side="right")) - 1
    before = g * plan.slots // groups
    counts = (g + 1) * plan.slots // groups - before
    total, lo, hi = int(counts.sum()), 0, int(first[g + 1] - first[g])
    shards, k = hi, shard - int(first[g])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([plan.seed, g, lo, hi])
        left = rng.multivariate_hypergeometric(counts, mid * total // shards - lo * total // shards, method="marginals")
        if k < mid:
            counts, hi = left, mid
        else:
            before, counts, lo = before + left, counts - left, mid
    return counts, before


def mixture(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(parts, mix) of ``docs(<row columns>, source, size)``, every row with size in words.

    ``parts``: the rows with source_size and target, one for each block they lie in (a row without
    words once), with block, from_word and n_words of the row in the block, and offset in the block.
    ``mix``: the slots of the output (shard, slot, source, block, words, epoch); words is how much of the
    block is taken, less than the block for the last slot of a source only.
    Sources come by code point, null last, and weigh ``weights`` in turn.
    """
    spark = docs.sparkSession
    rows = docs.count()
    summed = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    sums = summed.limit(SENT_SOURCES + 1).collect()
    if len(sums) > SENT_SOURCES:
        table, mix = _many_sources(summed, block, seed, weights, most)
        return _parts(docs, table, rows, block, SALTS), mix
    sums = sorted(((r.source, int(r["size"] or 0)) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
    plan = make_plan([n for _, n in sums], [weights[i % len(weights)] for i in range(len(sums))], block, seed, most)
    table = spark.createDataFrame([(s, i, n, float(t)) for i, ((s, n), t) in enumerate(zip(sums, plan.target))], "source string, s int, source_size long, target double")
    groups, first = shard_table(plan)
    shared = spark.sparkContext.broadcast((plan, groups, first))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, groups, first = shared.value
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = draw(plan, groups, first, shard)
                source = np.repeat(np.arange(len(counts)), counts)
                blocks, words, epochs = (np.zeros(len(source), dtype=np.int64) for _ in range(3))
                at = 0
                for s in np.flatnonzero(counts):
                    n = int(counts[s])
                    slot = np.arange(before[s], before[s] + n)
                    blocks[at : at + n] = plan.block_of(int(s), slot)
                    epochs[at : at + n] = slot // plan.blocks[s]
                    words[at : at + n] = np.where(slot == plan.slots[s] - 1, plan.last[s], plan.block)
                    at += n
                order = np.random.default_rng([plan.seed, shard, 7]).permutation(len(source))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard)), pa.array(np.arange(len(source))),
                    *[pa.array(x[order]) for x in (source, blocks, words, epochs)]], ["shard", "slot", "s", "block", "words", "epoch"])

    shards = int(first[-1])
    mix = spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInArrow(slots, "shard long, slot long, s long, block long, words long, epoch long")
    return _parts(docs, table, rows, block), mix


def _parts(docs: DataFrame, table: DataFrame, rows: int, block: int, salts: int = 0) -> DataFrame:
    """``docs`` beside their sources in ``table(source, s, source_size, target)``, a row for each block that they lie in.

    Up to SENT_SOURCES sources are broadcast.  Of more, one may have most rows: its rows are dealt to ``salts`` copies of it.
    """
    table = table.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if salts:
        copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int"))
        named = salted.join(copies, same & (F.col("_salt") == F.col("_copy"))).drop("_source", "_copy", "_salt")
    else:
        named = docs.join(F.broadcast(table), same).drop("_source")
    # rows without an id, or with one id, are spread by their texts; not by numbers that another run would give them
    order = ["doc_id", "size", *[c for c in docs.columns if c not in ("doc_id", "size", "source")]]
    placed = running_totals(named, ["s"], [c for c in order if c not in ("_row", "copy")], order, "size", slice_count(rows), "start")
    end = F.col("start") + F.col("size")
    inside = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    parts = placed.withColumn("block", F.explode_outer(inside))
    begin = F.greatest("start", F.col("block") * block)
    return parts.withColumn("offset", begin - F.col("block") * block).withColumn("from_word", begin - F.col("start")).withColumn("n_words",
        F.least(end, (F.col("block") + 1) * block) - begin)


def _water_level(table: DataFrame, most: float) -> float | None:
    """The level L at which the sources' least(most * size, L * weight) add up to all sizes; from a few sums a round."""
    total = float(table.agg(F.sum("size")).first()[0] or 0)
    level, before = 0.0, None
    while before != level:
        full = F.lit(level) * F.col("weight") > most * F.col("size")
        r = table.agg(F.sum(F.when(full, most * F.col("size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r.open:
            return None
        before, level = level, (total - (r.held or 0.0)) / r.open
    return level


def _many_sources(summed: DataFrame, block: int, seed: int, weights: tuple[float, ...], most: float) -> tuple[DataFrame, DataFrame]:
    """``table`` and ``mix`` where the plan would be too large to send: sources stay rows.

    Sources are sorted by ranges and numbered from the ranges' counts.  All slots, source by source, are
    one run of numbers; a permutation of it gives each slot its shard and place, which is how a draw without
    replacement deals every source's slots to the shards.  A source's slots are made by ranges of RANGE_SLOTS.
    """
    ranged = summed.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))

    def before(df: DataFrame, amount, out: str) -> DataFrame:
        """Adds ``out``: the sum of ``amount`` over the sources before; ranges are added up first."""
        sums = df.groupBy("_part").agg(F.sum(amount).alias("_sum"))  # a row for each range
        starts = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding,
            -1)), F.lit(0)).alias("_start"))
        inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(starts, F.col("_part") == F.col("_p")).withColumn(out,
            (F.col("_start") + F.col("_in")).cast("long")).drop("_in", "_p", "_start")

    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("s") % len(weights) + 1).cast("int"))
    table = cut(before(ranged, F.lit(1), "s").withColumn("weight", weight))
    level = _water_level(table, most)
    cap = most * F.col("size")
    target = cap if level is None else F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    table = table.withColumn("target", target.cast("double"))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [slots_of(n, round(want), block, lambda epoch, s=s: pass_key(seed, s, epoch)) for s, n,
                want in zip(*(b.column(c).to_pylist() for c in ("s", "size", "target")))]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]], [*b.schema.names, "slots", "last"])

    plain = table.select("source", "s", "size", "target", "_part", "_at")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    plan = cut(before(plain.mapInArrow(planned, f"{kinds}, slots long, last long"), F.col("slots"), "first"))
    total = int(plan.agg(F.sum("slots")).first()[0] or 0)
    ranges = plan.where("slots > 0").select("s", "size", "slots", "last", "first", F.explode(F.sequence(F.lit(0).cast("long"),
        F.expr(f"(slots - 1) div {RANGE_SLOTS}"))).alias("_range")).repartition("s", "_range")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, size, n, last, first, r in zip(*(c.to_pylist() for c in b.columns)):
                slot = np.arange(r * RANGE_SLOTS, min(n, (r + 1) * RANGE_SLOTS))
                blocks = -(-size // block)
                place = permuted(first + slot, total, pass_key(seed, 0, 0) ^ 0x5107)
                words = np.where(slot == n - 1, last, block)
                columns = [place // SHARD_BLOCKS, place % SHARD_BLOCKS, np.full(len(slot), s), blocks_at(slot, blocks, lambda epoch: pass_key(seed, s,
                    epoch)), words, slot // blocks]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["shard", "slot", "s", "block", "words", "epoch"])

    mix = ranges.mapInArrow(slots, "shard long, slot long, s long, block long, words long, epoch long")
    return plan.select("source", F.col("s").cast("int").alias("s"), F.col("size").alias("source_size"), "target"), mix


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) and a hash of the text."""
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return pick(docs, "doc_id", "source", "text").select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("text_hash"))


def taken_parts(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``parts``, each joined with the slots that take its block; ``take`` words from ``from_word`` on."""
    parts, mix = mixture(docs, **options)
    # the planner can't see how many slots a shard has, and would broadcast them all
    joined = parts.join(mix.select("s", "block", "words", "epoch").hint("merge"), ["s", "block"], "left")
    return joined.withColumn("take", F.coalesce(F.least("n_words", F.greatest(F.lit(0), F.col("words") - F.col("offset"))), F.lit(0)))


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs(doc_id, source, text)``.

    Null texts have no words; a source without words has target 0; a null source is a source, the last;
    repeated rows and ids are rows of their own; an empty table gives an empty one; other columns are
    ignored.  Blocks and slots meet by (source, block), so a source with most rows is spread evenly.
    """
    keys = ["s", "start", "doc_id", "size", "text_hash", "_row"]
    rows = cut(sized(docs).withColumn("_row", F.monotonically_increasing_id()))
    sums = taken_parts(rows, **options).groupBy(*keys).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("take").cast("long").alias("taken"))
    return sums.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: for each pass over its source, a row holds the words taken from it.

    A document taken whole keeps its text; one taken in part has the taken words, in order, with the
    white space between them (a gap becomes a line break).  A document taken twice gives two rows.  Rows
    equal in id, text and source are documents of their own in the mix; its rows have the other columns of one of them.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc_id, text, source = (f"c{columns.index(c)}" for c in ("doc_id", "text", "source"))
    keys = ["doc_id", "source", "text_hash"]
    grouped = cut(sized(docs).groupBy(*keys, "size").agg(F.count("*").alias("n")))
    rows = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    taken = taken_parts(rows, **options).where("take > 0")
    taken = taken.groupBy(*keys, "copy", "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("from_word", "take"))).alias("spans"))
    taken = taken.select(*[F.col(k).alias(f"_{k}") for k in keys], "size", "spans")
    hashed = plain.withColumn("text_hash", F.xxhash64(text))
    if not grouped.where("n > 1").isEmpty():
        hashed = hashed.dropDuplicates([doc_id, source, "text_hash"])  # equal rows merge where they are, before they meet
    joined = hashed.join(taken, F.col(doc_id).eqNullSafe(F.col("_doc_id")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_text_hash")))
    word = re.compile(_WORD)

    @F.pandas_udf("string")
    def spoken(texts, spans, sizes):
        out = []
        for t, some, size in zip(texts, spans, sizes):
            runs = []
            for x in some:
                a, n = x["from_word"], x["take"]
                if runs and runs[-1][1] == a:
                    runs[-1][1] = a + n
                else:
                    runs.append([a, a + n])
            if runs == [[0, size]]:
                out.append(t)
            else:
                at = [m.span() for m in word.finditer(t)]
                out.append("\n".join(t[at[a][0] : at[b - 1][1]] for a, b in runs))
        give_back()
        return texts.__class__(out)

    changed = joined.withColumn("_text", spoken(text, "spans", "size"))
    out = [F.col("_text") if c == text else F.length("_text").cast(docs.schema.fields[i].dataType) if columns[i] == "n_chars" else F.col(c) for i, c in enumerate(plain.columns)]
    return changed.select(*[c.alias(f"c{i}") for i, c in enumerate(out)]).toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
