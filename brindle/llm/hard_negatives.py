"""Operator 11: hard negatives by a dual-tree search of inner products.

Rows fall into the leaves of a small tree, and there into blocks; each block is a tree of its own.  Anchors and
candidates have such trees both.  Pairs of nodes whose interval of inner products can't hold a wanted score are
dropped with all that is below them: cells first, then blocks, then the nodes inside two blocks; pairs of leaves
are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, pick, shared_path

SCALE, LABELS, ANCHOR_EVERY, SHIFT_EVERY = 256, 10, 100, 7
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows of a block at most, of a leaf inside a block; leaves of the top tree and groups of labels, whose product is the
#: number of cells; rows that the top tree is fitted on, about; blocks that an anchors' block meets in one task.
_BITS = 12  # of a row's place in its block
BLOCK_ROWS, LEAF_ROWS, LEAVES, GROUPS, SAMPLE_ROWS, MEET = 1 << _BITS, 32, 64, 16, 4096, 64
_LEAST = -(2**63)
_BLOCK = "block long, cell int, n int, min_label long, max_label long, center binary, radius double, reach double, width int, wide boolean, ids array<long>, labels array<long>, keys array<long>, vectors binary"
_BLOCK_TYPE = pa.schema(
    [("block", pa.int64()), ("cell", pa.int32()), ("n", pa.int32()), ("min_label", pa.int64()), ("max_label", pa.int64()), ("center", pa.binary()),
        ("radius", pa.float64()), ("reach", pa.float64()), ("width", pa.int32()),
     ("wide", pa.bool_()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("vectors", pa.binary())]
)


# Vectors of whole numbers, padded with zeros to a common width


def whole_numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(SCALE * x) of their components as doubles, which hold them exactly."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not finite
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(SCALE * values)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = lists.is_valid().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(values)]] = False
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    matrix[row, at] = values
    return good, matrix


def _stored(matrix: np.ndarray) -> tuple[bool, bytes]:
    wide = bool(np.abs(matrix).max(initial=0) > 32767)
    return wide, matrix.astype("<f8" if wide else "<i2").tobytes()


def _read(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], "<f8" if row["wide"] else "<i2").reshape(row["n"], row["width"]).astype(np.float64)


def _same_width(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[-1] for m in matrices)
    return [m if m.shape[-1] == width else np.pad(m, [(0, 0)] * (m.ndim - 1) + [(0, width - m.shape[-1])]) for m in matrices]


def intervals(a: np.ndarray, ra: np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of points of balls around a with points of balls around c, a little widened."""
    a, c = _same_width(a, c)
    dots = a @ c.T
    na, nc = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(c, axis=1)[None, :]
    ra, rc = ra[:, None], rc[None, :]
    spread = ra * nc + na * rc + ra * rc
    spread += 1 + 1e-9 * (spread + na * nc)
    return dots - spread, dots + spread


# The top tree, from a sample


@dataclass
class TopTree:
    """A perfect binary tree of planes; ``centers[d]`` are points for the nodes at depth d."""

    normals: list[np.ndarray] = field(default_factory=list)
    offsets: list[np.ndarray] = field(default_factory=list)
    centers: list[np.ndarray] = field(default_factory=list)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        for normals, offsets in zip(self.normals, self.offsets):
            r, n = _same_width(rows, normals)
            at = 2 * at + (np.einsum("ij,ij->i", r, n[at]) > offsets[at])
        return at


def fit_top(sample: np.ndarray, depth: int) -> TopTree:
    """Halves each node along the line between two points far apart."""
    tree, parts = TopTree(), [sample]
    for level in range(depth + 1):
        tree.centers.append(np.stack([p.mean(axis=0) if len(p) else np.zeros(sample.shape[1]) for p in parts]))
        if level == depth:
            break
        normals, offsets, halves = [], [], []
        for p, center in zip(parts, tree.centers[-1]):
            one = p[np.argmax(((p - center) ** 2).sum(axis=1))] if len(p) else center
            other = p[np.argmax(((p - one) ** 2).sum(axis=1))] if len(p) else center
            along = p @ (other - one)
            normals.append(other - one)
            offsets.append(float(np.median(along)) if len(p) else 0.0)
            right = along > offsets[-1]
            halves += [p[~right], p[right]]
        tree.normals.append(np.stack(normals))
        tree.offsets.append(np.array(offsets))
        parts = halves
    return tree


# The tree inside a block


class BlockTree:
    """A perfect binary tree over the rows of a matrix, each node halved along its widest coordinate."""

    def __init__(self, matrix: np.ndarray, leaf_rows: int = LEAF_ROWS):
        parts = [np.arange(len(matrix))]
        self.matrix, self.centers, self.radii = matrix, [], []
        while True:
            balls = [ball(matrix[p]) for p in parts]
            self.centers.append(np.stack([b[0] for b in balls]))
            self.radii.append(np.array([b[1] for b in balls]))
            if max(map(len, parts)) <= leaf_rows:
                break
            halves = []
            for p in parts:
                some = matrix[p]
                wide = int(np.argmax(some.max(axis=0) - some.min(axis=0))) if some.size else 0
                order = p[np.argsort(some[:, wide], kind="stable")] if some.shape[1] else p
                halves += [order[: len(p) // 2], order[len(p) // 2 :]]
            parts = halves
        self.leaves = parts
        self.depth = len(self.centers) - 1


def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
    center = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])
    return center, float(np.sqrt(((rows - center) ** 2).sum(axis=1).max(initial=0)))


class Search:
    """The best rows of each slot of an anchors' block so far.  Anchor i has the slots i * wanted ... of ``low`` to ``high``."""

    def __init__(self, anchors: dict, low: np.ndarray, high: np.ndarray, best: int, same_label: bool):
        self.matrix = _read(anchors)
        self.tree = BlockTree(self.matrix)
        self.labels, self.keys = np.array(anchors["labels"]), np.array(anchors["keys"])
        self.floor, self.high, self.best, self.same = low.astype(np.int64), high.astype(np.int64), best, same_label
        empty = np.zeros(0, dtype=np.int64)
        #: for each leaf: slot, score, whether the id is null, id, key
        self.pools = [(empty,) * 5 for _ in self.tree.leaves]

    def meet(self, block: dict) -> None:
        """Takes what a block of candidates has, if no pair of nodes above rules it out."""
        matrix = _read(block)
        a, c = _same_width(self.matrix, matrix)
        norms = [np.sqrt((m * m).sum(axis=1).max(initial=0)) for m in (a, c)]
        exact = norms[0] * norms[1] < 2**53  # every sum of products is then a whole number that a double holds
        tree, labels, keys = BlockTree(c), np.array(block["labels"]), np.array(block["keys"])
        ids = np.array([0 if i is None else i for i in block["ids"]], dtype=np.int64)
        nulls = np.array([i is None for i in block["ids"]], dtype=np.int64)
        alive, greatest = self._descend(tree)
        for i, own in enumerate(self.tree.leaves):
            near = np.flatnonzero(alive[i])
            if not len(own) or not len(near):
                continue
            near = near[np.argsort(-greatest[i, near], kind="stable")]
            for at in range(0, len(near), 8):
                if greatest[i, near[at]] < self.floor[own].min():
                    break
                rows = np.concatenate([tree.leaves[j] for j in near[at : at + 8]])
                scores = a[own] @ c[rows].T if exact else self._wide(a[own], c[rows])
                fits = (self.labels[own][:, None] == labels[rows][None, :]) == self.same
                fits &= self.keys[own][:, None] != keys[rows][None, :]
                found = []
                for s in range(self.floor.shape[1]):
                    x, y = np.nonzero(fits & (scores >= self.floor[own, s][:, None]) & (scores <= self.high[own, s][:, None]))
                    found.append((own[x] * self.floor.shape[1] + s, scores[x, y].astype(np.int64), nulls[rows[y]], ids[rows[y]], keys[rows[y]]))
                self._merge(i, [np.concatenate(f) for f in zip(self.pools[i], *found)])

    def _descend(self, tree: BlockTree) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of leaves may hold a wanted score, and the greatest score of each pair."""
        mine, alive = self.tree, np.ones((1, 1), dtype=bool)
        floor, high = self.floor.min(axis=1).astype(float), self.high.max(axis=1).astype(float)
        least_of, most_of = (np.array([f(x[g]) if len(g) else e for g in mine.leaves]) for x, f, e in ((floor, np.min, np.inf), (high, np.max, -np.inf)))
        for level in range(max(mine.depth, tree.depth) + 1):
            i, j = min(level, mine.depth), min(level, tree.depth)
            low, most = intervals(mine.centers[i], mine.radii[i], tree.centers[j], tree.radii[j])
            need, limit = (f.reshape(len(mine.centers[i]), -1) for f in (least_of, most_of))
            if level:
                alive = np.repeat(alive, 2, axis=0) if level <= mine.depth else alive
                alive = np.repeat(alive, 2, axis=1) if level <= tree.depth else alive
            alive &= (most >= need.min(axis=1)[:, None]) & (low <= limit.max(axis=1)[:, None])
        return alive, most

    @staticmethod
    def _wide(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of any size in Python's whole numbers; beyond a long they stay at its ends."""
        ints = [np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape) for m in (a, c)]
        return np.clip(ints[0] @ ints[1].T, _LEAST, 2**63 - 1)

    def _merge(self, leaf: int, pool: list[np.ndarray]) -> None:
        slot, score, null, ident, key = pool
        order = np.lexsort((key, ident, null, -score.astype(object) if score.min(initial=0) == _LEAST else -score, slot))
        slot = slot[order]
        first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, dtype=bool)
        nth = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        kept = nth < self.best
        self.pools[leaf] = tuple(x[kept] for x in (slot, score[order], null[order], ident[order], key[order]))
        last = nth == self.best - 1
        wanted = self.floor.shape[1]
        self.floor[slot[last] // wanted, slot[last] % wanted] = score[order][last]

    def rows(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.pools)]


# The tables


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, group, vector of rows that may take part, and n, which tells rows apart."""
    rows = pick(vectors, "vec_id", "label", "embedding").where("label is not null and embedding is not null")
    label = F.col("label").cast("long")
    shifted = F.when(F.coalesce(F.col("vec_id") % SHIFT_EVERY == 0, F.lit(False)), (label + 1) % LABELS).otherwise(label)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"), "embedding", F.xxhash64(F.monotonically_increasing_id()).alias("n"))
    return rows.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))


def _fitted(rows: DataFrame, total: int) -> tuple[TopTree, int, dict[int, int], dict[int, int]]:
    """The top tree, the depth of the anchors' cells in it, and into how many slices cells of candidates and of anchors fall.

    From SAMPLE_ROWS rows, about, and 4 times as many at most: they make the trees good, and change no result.
    """
    every = max(1, total // SAMPLE_ROWS)
    taken = rows.where(F.pmod("n", F.lit(every)) == 0).limit(4 * SAMPLE_ROWS).select("vec_id", "group", "embedding").toArrow()
    good, sample = whole_numbers(pa.concat_arrays(taken.column("embedding").chunks) if taken.num_rows else pa.array([], pa.list_(pa.float64())))
    depth_for = lambda n: min(LEAVES.bit_length() - 1, max(0, (-(-n // BLOCK_ROWS) - 1).bit_length()))
    is_anchor = np.array([i is not None and i % ANCHOR_EVERY == 0 for i in taken.column("vec_id").to_pylist()], dtype=bool)
    share = total / max(1, taken.num_rows)
    anchors = int(max(is_anchor.sum(), len(is_anchor) / ANCHOR_EVERY) * share)
    tree, depth = fit_top(sample[good], depth_for(total)), depth_for(anchors)
    cells = taken.column("group").to_numpy()[good].astype(np.int64) * LEAVES + tree.leaves(sample[good]) if good.any() else np.zeros(0, np.int64)
    depth = min(depth, len(tree.normals))
    slices = {int(c): int(-(-n * share // BLOCK_ROWS)) for c, n in zip(*np.unique(cells, return_counts=True)) if n * share > BLOCK_ROWS}
    upper = cells // LEAVES * LEAVES + (cells % LEAVES >> len(tree.normals) - depth)
    part = max(is_anchor.mean() if len(is_anchor) else 0, 1 / ANCHOR_EVERY)
    anchor_slices = {int(c): int(-(-n * share * part // BLOCK_ROWS)) for c, n in zip(*np.unique(upper, return_counts=True)) if n * share * part > BLOCK_ROWS}
    return tree, depth, slices, anchor_slices


def _blocks(rows: DataFrame, tree, depth: int, path: str) -> DataFrame:
    """Writes and reads blocks of ``rows(cell, slice, vec_id, label, key, wide, width, vector)``; a null key is made from the block."""
    ordered = rows.repartition("cell", "slice").sortWithinPartitions("cell", "slice").select("cell", "slice", "vec_id", "label", "key", "vector")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = tree.value.centers[depth]
        open_rows, now, nth = [], None, 0

        def block() -> pa.RecordBatch:
            vectors = [np.frombuffer(r[3], "<f8") for r in open_rows]
            matrix = np.zeros((len(vectors), max(map(len, vectors))))
            for m, v in zip(matrix, vectors):
                m[: len(v)] = v
            center, radius = ball(matrix)
            m, c = _same_width(matrix, centers[now[0] % LEAVES][None, :])
            number = now[0] << 40 | now[1] << 20 | nth
            labels, keys = [r[1] for r in open_rows], [number << _BITS | i if r[2] is None else r[2] for i, r in enumerate(open_rows)]
            wide, data = _stored(matrix)
            row = {"block": number, "cell": now[0], "n": len(matrix), "min_label": min(labels), "max_label": max(labels), "center": center.tobytes(),
                "radius": radius, "reach": float(np.sqrt(((m - c) ** 2).sum(axis=1).max())),
                   "width": matrix.shape[1], "wide": wide, "ids": [r[0] for r in open_rows], "labels": labels, "keys": keys, "vectors": data}
            return pa.RecordBatch.from_pylist([row], _BLOCK_TYPE)

        for b in batches:
            for cell, part, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (cell, part) != now or len(open_rows) == BLOCK_ROWS:
                    if open_rows:
                        yield block()
                    nth = nth + 1 if (cell, part) == now else 0
                    open_rows, now = [], (cell, part)
                open_rows.append(row)
        if open_rows:
            yield block()
        give_back()

    ordered.mapInArrow(work, _BLOCK).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _candidates(rows: DataFrame, tree, slices: dict[int, int], path: str) -> DataFrame:
    """Blocks of all rows, by leaf and group of labels."""
    names = ["cell", "slice", "vec_id", "label", "key", "vector"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, matrix = whole_numbers(b.column("embedding"))
            at = np.flatnonzero(good)
            rows, sizes = matrix[at], b.column("embedding").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[at]
            cells = b.column("group").to_numpy()[at].astype(np.int64) * LEAVES + tree.value.leaves(rows)
            parts = (b.column("n").to_numpy()[at] >> 8 & 0xFFFFFFFF) % np.array([slices.get(c, 1) for c in cells.tolist()], dtype=np.int64) if len(at) else at
            where = pa.array(at)
            vectors = pa.array([r[:n].astype("<f8").tobytes() for r, n in zip(rows, sizes.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(parts, pa.int32()), b.column("vec_id").take(where),
                b.column("label").take(where), pa.nulls(len(at), pa.int64()), vectors], names)

    placed = rows.select("vec_id", "label", "embedding", "n", "group").mapInArrow(place, "cell int, slice int, vec_id long, label long, key long, vector binary")
    return _blocks(placed, tree, -1, path)


def _anchors(blocks: DataFrame, tree, depth: int, slices: dict[int, int], path: str) -> DataFrame:
    """Blocks of the anchors alone, by a higher node of the tree and group of labels; keys are those among the candidates."""
    names = ["cell", "slice", "vec_id", "label", "key", "vector"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = len(tree.value.normals) - depth
        for b in batches:
            for r in b.to_pylist():
                at = [i for i, x in enumerate(r["ids"]) if x is not None and x % ANCHOR_EVERY == 0]
                cell = r["cell"] // LEAVES * LEAVES + (r["cell"] % LEAVES >> up)
                matrix, n = _read(r), slices.get(cell, 1)
                columns = [pa.array([cell] * len(at), pa.int32()), pa.array([r["keys"][i] * 0x9E3779B1 % (1 << 61) % n for i in at], pa.int32()),
                    *[pa.array([r[c][i] for i in at], pa.int64()) for c in ("ids", "labels", "keys")]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([matrix[i].astype("<f8").tobytes() for i in at], pa.binary())], names)

    return _blocks(blocks.mapInArrow(place, "cell int, slice int, vec_id long, label long, key long, vector binary"), tree, depth, path)


def _cells(blocks: DataFrame, *more: Column) -> list:
    """One row of each cell, LEAVES * GROUPS at most."""
    return blocks.groupBy("cell").agg(F.max("reach").alias("reach"), F.min("min_label").alias("min_label"), F.max("max_label").alias("max_label"), *more).orderBy("cell").collect()


def _pairs(anchors: DataFrame, blocks: DataFrame, tree: TopTree, depth: int, same_label: bool) -> DataFrame:
    """(anchors' block, block, most, part) of pairs of blocks that may hold a wanted score: cells are compared first, then their blocks.

    ``anchors`` has low and high, the scores that the block wants.
    """
    spark = blocks.sparkSession
    one, two = _cells(anchors, F.min("low").alias("low"), F.max("high").alias("high")), _cells(blocks)
    low, most = intervals(tree.centers[depth][[r.cell % LEAVES for r in one]], np.array([r.reach for r in one]),
        tree.centers[-1][[r.cell % LEAVES for r in two]], np.array([r.reach for r in two]))
    fits = (most >= np.array([r.low for r in one], dtype=float)[:, None]) & (low <= np.array([r.high for r in one], dtype=float)[:, None])
    (a0, a1), (c0, c1) = (np.array([(r.min_label, r.max_label) for r in x]).T for x in (one, two))
    if same_label:
        fits &= np.array([r.cell // LEAVES for r in one])[:, None] == np.array([r.cell // LEAVES for r in two])[None, :]
    else:
        fits &= ~((a0 == a1)[:, None] & (c0 == c1)[None, :] & (a0[:, None] == c0[None, :]))
    i, j = np.nonzero(fits)
    cells = spark.createDataFrame(pa.table({"cell": pa.array([one[x].cell for x in i], pa.int32()), "other": pa.array([two[x].cell for x in j], pa.int32())}))
    parts = max(1, -(-blocks.count() // MEET))
    ours = anchors.select("cell", F.col("block").alias("mine"), F.col("center").alias("c1"), F.col("radius").alias("r1"),
        F.col("min_label").alias("a0"), F.col("max_label").alias("a1"), "low", "high")
    theirs = blocks.select(F.col("cell").alias("other"), "block", F.col("center").alias("c2"), F.col("radius").alias("r2"),
        F.col("min_label").alias("b0"), F.col("max_label").alias("b1"))
    wanted = F.expr("a0 <= b1 and b0 <= a1") if same_label else F.expr("not (a0 = a1 and b0 = b1 and a0 = b0)")
    met = ours.join(cells, "cell").join(theirs, "other").where(wanted).select("mine", "block", "c1", "r1", "c2", "r2", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for mine, block, c1, r1, c2, r2, low, high in zip(*(c.to_pylist() for c in b.columns)):
                least, most = intervals(np.frombuffer(c1)[None, :], np.array([r1]), np.frombuffer(c2)[None, :], np.array([r2]))
                if most[0, 0] >= low and least[0, 0] <= high:
                    out.append((mine, block, float(most[0, 0])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["mine", "block", "most"])

    return met.mapInArrow(compare, "mine long, block long, most double").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))


def _searched(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, best: int, same_label: bool) -> DataFrame:
    """anchor, slot, score, id, key: the best of each slot that each task has found.

    An anchors' block goes once to each of its parts, and the blocks that it meets there follow, the most promising first.
    """
    pairs = cut(pairs)
    body = ["n", "width", "wide", "ids", "labels", "keys", "vectors"]
    heads = pairs.select("mine", "part").distinct().join(anchors.select(F.col("block").alias("mine"), *body, "slots"), "mine").select("mine", "part",
        F.lit(None).cast("double").alias("most"), *body, "slots")
    tails = pairs.join(blocks.select("block", *body), "block").select("mine", "part", "most", *body, F.lit(None).cast(anchors.schema["slots"].dataType).alias("slots"))
    ordered = heads.unionByName(tails).repartition("mine", "part").sortWithinPartitions("mine", "part", F.desc_nulls_first("most"))
    names = ["mine", "anchor", "anchor_id", "slot", "positive_id", "positive_score", "score", "id", "key"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, head, mine = None, None, None

        def found() -> pa.RecordBatch:
            slot, score, null, ident, key = search.rows()
            wanted = search.floor.shape[1]
            who, nth = slot // wanted, slot % wanted
            ids, keys = (np.array([0 if x is None else x for x in head[c]], dtype=np.int64) for c in ("ids", "keys"))
            slots = head["slots"]
            of = [slots[i][s] for i, s in zip(who.tolist(), nth.tolist())] if not same_label else [{"id": None, "score": None}] * len(who)
            columns = [pa.array(np.full(len(who), mine)), pa.array(keys[who]), pa.array(ids[who]), pa.array(nth, pa.int32()),
                pa.array([x["id"] for x in of], pa.int64()), pa.array([x["score"] for x in of], pa.int64()), pa.array(score), pa.array(ident,
                mask=null.astype(bool)), pa.array(key)]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                if row["most"] is None:
                    if search:
                        yield found()
                    low, high = _bounds(row["slots"], same_label)
                    search, head, mine = Search(row, low, high, best, same_label), row, row["mine"]
                else:
                    search.meet(row)
        if search:
            yield found()
        give_back()

    return ordered.mapInArrow(work, "mine long, anchor long, anchor_id long, slot int, positive_id long, positive_score long, score long, id long, key long")


def _bounds(slots: list, same_label: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest wanted scores of each anchor's slots; a slot that is missing wants none."""
    if same_label:
        return np.full((len(slots), 1), _LEAST), np.full((len(slots), 1), 2**63 - 1)
    low, high = np.full((len(slots), POSITIVES), 2**63 - 1), np.full((len(slots), POSITIVES), _LEAST)
    for i, some in enumerate(slots):
        for j, x in enumerate(some):
            low[i, j], high[i, j] = -(-LOW * x["score"] // 100), HIGH * x["score"] // 100
    return low, high


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors(vec_id, label, embedding)``.

    Rows with a null label or vector, or a component that isn't finite (or isn't, times SCALE), take no part.  A row
    without an id is a candidate, behind others of its score.  Rows that repeat are rows of their own: each is an
    anchor, and the other's positive.  Shorter vectors end with zeros.  A score beyond a long stands at its end.  An
    empty table gives an empty one; other columns are ignored.  No task holds more than a block of anchors with its
    best rows, and one of candidates; a label of most rows falls into blocks like others.
    """
    spark = vectors.sparkSession
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = _prepared(vectors)
    top, depth, slices, anchor_slices = _fitted(rows, vectors.count())
    tree = spark.sparkContext.broadcast(top)
    blocks = _candidates(rows, tree, slices, shared_path(spark, "candidates"))
    anchors = _anchors(blocks, tree, depth, anchor_slices, shared_path(spark, "anchors"))
    if anchors.isEmpty():
        return none
    slot = "array<array<struct<id: bigint, score: bigint>>>"
    open_anchors = anchors.withColumns({"low": F.lit(_LEAST + 1) - 1, "high": F.lit(2**63 - 1), "slots": F.expr(f"cast(transform(ids, x -> array()) as {slot})")})
    near = _searched(open_anchors, blocks, _pairs(open_anchors, blocks, top, depth, True), POSITIVES, True)
    order = [F.desc("score"), F.asc_nulls_last("id"), "key"]
    near = cut(near.withColumn("nth", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("nth") <= POSITIVES))
    # each anchors' block gets its anchors' positives, POSITIVES for each row at most
    each = near.groupBy("mine", "anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("best"))
    wanted = near.withColumn("least", -F.floor(-F.col("score").cast("decimal(20,0)") * LOW / 100)).withColumn("most",
        F.floor(F.col("score").cast("decimal(20,0)") * HIGH / 100)).where("least <= most")
    limits = wanted.groupBy(F.col("mine").alias("block")).agg(F.min("least").cast("long").alias("low"), F.max("most").cast("long").alias("high"))
    given = each.groupBy(F.col("mine").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("anchor",
        F.expr("transform(best, x -> struct(x.id as id, x.score as score))").alias("s")))).alias("given"))
    ready = anchors.join(limits, "block").join(given, "block")
    ready = cut(ready.withColumn("slots", F.expr(f"cast(transform(keys, x -> coalesce(given[x], array())) as {slot})")).drop("given"))
    if ready.isEmpty():
        return none
    far = _searched(ready, blocks, _pairs(ready, blocks, top, depth, False), NEGATIVES, False)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))
    far = far.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
