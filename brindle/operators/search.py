"""Exact nearest-neighbour search, gates, reranking, and what is read off the results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries times dimensions, and queries times k, that a task holds at most; more queries are searched in several passes.
QUERY_CELLS, BEST_CELLS = 1_000_000, 200_000
#: Scores (queries times rows of the base) that a task holds at once, and slices of a term's documents.
SCORE_CELLS, TERM_SLICES = 500_000, 8
#: Texts whose counts of characters a task holds at once.
ALIKE_ROWS = 2_000


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size).astype(np.float64)


def _least(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the n least of each row of ``key``, of equal ones the first; nan comes last."""
    key = np.where(np.isnan(key), np.inf, key)
    last = np.partition(key, n - 1, axis=1)[:, n - 1 : n]
    less, equal = key < last, key == last
    wanted = n - less.sum(axis=1, keepdims=True)
    return np.nonzero(less | equal & (np.cumsum(equal, axis=1) <= wanted))


def _near(key: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what may be among the k least of each row: not above ``worst``, and k of a row at most."""
    near = key <= worst[:, None]
    crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
    if len(crowded):
        row, col = _least(key[crowded], k)
        near[crowded] = False
        near[crowded[row], col] = True
    return np.nonzero(near)


def _merged(parts: list[pa.Table], k: int, worst: np.ndarray) -> pa.Table:
    """The k best of each query of all parts, ties to the smaller id; ``worst`` becomes each query's k-th key."""
    both = pa.concat_tables(parts)
    both = both.take(pc.sort_indices(both, [("row", "ascending"), ("key", "ascending"), ("id", "ascending")]))
    row = both.column("row").to_numpy()
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    worst[row[nth == k - 1]] = both.column("key").to_numpy()[nth == k - 1]
    return both.filter(pa.array(nth < k))


def topk(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", query_id: str = "qid", base_id: str = "vec_id",
    vector: str = "embedding", digits: int | None = None, embed: Callable[[list[str]], np.ndarray] | None = None, text: str = "text") -> DataFrame:
    """(qid, vec_id, score, rank): the k best rows of ``base`` for each query, ties to the smaller id.

    metric: cosine or dot (large is near), l2 or l2sq (small is near).  Every row is compared.  The base
    is never moved: each task multiplies its batches by the queries' matrix and keeps the k best of each query over
    all of them, and only these leave it.  The queries are a matrix of bounded size, as are the scores and the best rows
    held; where there are more queries, it is one pass over the base for each such matrix.  digits: scores are rounded before they are compared.
    embed: makes the base's vectors of its column ``text`` where they are searched, so that no vector leaves a worker.
    """
    near_is_small = metric in ("l2", "l2sq")
    spark = base.sparkSession
    rows = queries.select(F.col(query_id).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.select(F.size("v").alias("n")).first()
    schema = f"qid long, vec_id {base.schema[base_id].dataType.simpleString()}, score double"
    if first is None:
        return spark.createDataFrame([], schema + ", rank int")
    size = first.n
    per_pass = max(1, min(QUERY_CELLS // max(size, 1), BEST_CELLS // k))
    passes = -(-rows.count() // per_pass)
    searched = None
    for p in range(passes):
        some = rows.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p) if passes > 1 else rows
        got = some.collect()
        if not got:
            continue
        ids, matrix = np.array([r.qid for r in got]), np.array([r.v for r in got], dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            qq = (q * q).sum(axis=1)
            at_once = max(1, SCORE_CELLS // len(ids))
            # rows of the k best so far and those since, how many of either, and each query's k-th
            parts, merged, since, worst = [], 0, 0, np.full(len(ids), np.inf)
            for b in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once)):
                order = pc.sort_indices(b.column(0))
                x = _matrix(b.column(1), size) if embed is None else embed(b.column(1).to_pylist())
                base_ids, x = b.column(0).take(order), x[order.to_numpy()]
                score = q @ x.T
                if metric == "cosine":
                    score /= np.sqrt(qq)[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
                elif near_is_small:
                    score = np.maximum(qq[:, None] - 2 * score + (x * x).sum(axis=1)[None, :], 0)
                    if metric == "l2":
                        score = np.sqrt(score)
                if digits is not None:
                    score = np.round(score, digits) + 0.0
                key = score.copy() if near_is_small else -score
                key[np.isnan(key)] = np.inf
                row, col = _near(key, worst, k)
                if not len(row):
                    continue
                parts.append(pa.table({"row": row, "key": key[row, col], "id": base_ids.take(pa.array(col)), "score": score[row, col]}))
                since += len(row)
                if since >= merged:  # sorted once for as many new rows as there are best ones
                    parts = [_merged(parts, k, worst)]
                    merged, since = len(parts[0]), 0
            if parts:
                for some in _merged(parts, k, worst).combine_chunks().to_batches(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(some.column("row")), some.column("id"), some.column("score")], ["qid", "vec_id", "score"])

        found = base.select(F.col(base_id).alias("vec_id"), F.col(text if embed else vector)).mapInArrow(work, schema)
        searched = found if searched is None else searched.union(found)
    order = F.col("score").asc() if near_is_small else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, "vec_id"))
    return searched.withColumn("rank", rank).where(F.col("rank") <= k)


def overfetch_dedupe(ranked: DataFrame, key: str, k: int, query_id: str = "qid") -> DataFrame:
    """Of a pool already cut to size, the best row of each key, then the k best, ranked anew."""
    one = Window.partitionBy(query_id, key).orderBy("rank")
    again = Window.partitionBy(query_id).orderBy("rank")
    first = ranked.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return first.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= k).drop("rank").withColumnRenamed("_r", "rank")


def nearest_above(ranked: DataFrame, threshold: float) -> DataFrame:
    """The best row of a query if its score reaches the threshold: a semantic cache's lookup."""
    return ranked.where((F.col("rank") == 1) & (F.col("score") >= threshold))


def distance_gate(ranked: DataFrame, text: Column, most: float, fallback: str) -> DataFrame:
    """(qid, vec_id, score, answer): the nearest text, or the fallback where even that is too far."""
    return ranked.where("rank = 1").select("qid", "vec_id", "score", F.when(F.col("score") > most, fallback).otherwise(text).alias("answer"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, n_common, same_order) of two rankings."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias(name))

    both = listed(a, "x").join(listed(b, "y"), "qid")
    return both.select("qid", F.size(F.array_intersect("x", "y")).cast("long").alias("n_common"), (F.col("x") == F.col("y")).alias("same_order"))


def rerank(candidates: DataFrame, score: Column, query_id: str = "query", position: str = "pos") -> DataFrame:
    """Candidates in falling order of another score, equal ones in the order given."""
    w = Window.partitionBy(query_id).orderBy(F.desc("reranker_score"), position)
    return candidates.withColumn("reranker_score", score).withColumn("rank", F.row_number().over(w))


def keyword_docs(queries: DataFrame, keywords: dict[str, str], default: str, text: str = "text") -> DataFrame:
    """queries with doc_ids: the documents of the keywords found, in keyword order, each once; else the default."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(f"(?i){k}"), d) for k, d in keywords.items()]))
    return queries.withColumn("doc_ids", F.when(F.size(hits) > 0, F.array_distinct(hits)).otherwise(F.array(F.lit(default))))


def knn_votes(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label, votes): the commonest label of each query's neighbours, ties to the smaller label."""
    votes = ranked.join(labels, "vec_id").groupBy("qid", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("qid").orderBy(F.desc("votes"), "label")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sparse_cosine(queries: DataFrame, docs: DataFrame, term: str = "term", weight: str = "weight") -> DataFrame:
    """(qid, doc_id, score) of pairs that share a term, by an inverted-list join.

    A term that most documents have pairs them all with the queries that have it, as its weight counts in
    every score; its documents fall into TERM_SLICES slices by id, and the queries' weights go to each.
    """
    q = queries.select("qid", F.col(term), F.col(weight).alias("wq"), F.explode(F.sequence(F.lit(0), F.lit(TERM_SLICES - 1))).alias("_slice"))
    d = docs.select("doc_id", F.col(term), F.col(weight).alias("wd"), F.pmod(F.xxhash64("doc_id"), F.lit(TERM_SLICES)).cast("int").alias("_slice"))
    return q.join(d, [term, "_slice"]).groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def best_of(scored: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best of (qid, doc_id, score), ties to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_chunks(chunks: DataFrame, score: Column, m: int, query_id: str = "qid") -> DataFrame:
    """chunks(qid, doc_id, chunk_id, text) scored anew, the m best of each query, with rank; ties in order of document and chunk."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "doc_id", "chunk_id")
    return chunks.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def zipped(chunks: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks beside the vectors of the same place; a chunk without a vector, or a vector without a chunk, stops the job."""
    both = chunks.withColumn("_a", F.lit(True)).join(vectors.withColumn("_b", F.lit(True)), keys, "full_outer")
    broken = F.raise_error(F.lit("as many vectors as chunks are wanted"))
    return both.withColumn(keys[0], F.when(F.col("_a").isNull() | F.col("_b").isNull(), broken).otherwise(F.col(keys[0]))).drop("_a", "_b")


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has characters of each of 256 classes."""
    out = np.zeros((len(texts), 256), dtype=np.int32)
    for row, t in zip(out, texts):
        row += np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") & 255, minlength=256)
    return out


def best_alike(queries: DataFrame, base: DataFrame, most_chars: int = 8_000_000) -> DataFrame:
    """(qid, id, score) of the text of base(id, text) most like each of queries(qid, text) with another id, 0 to 100.

    Likeness is Ratcliff-Obershelp's: twice the matched characters over all.  It is at most what the two texts' counts of
    characters have in common, which is one pass of minima over a batch; pairs are matched in falling order of that
    bound, and none below the best that the query has so far.  Queries are sent to the tasks, ``most_chars`` characters
    at a time (more of them: more passes); a task keeps the best of each query.  Ties go to the smaller id.
    """
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    passes, found = max(1, -(-chars // most_chars)), None
    for p in range(passes):
        some = [(r.qid, r.text or "") for r in queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p).select("qid", "text").collect()]
        shared = base.sparkSession.sparkContext.broadcast(some)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, int]] = {}
            asked = _letters([q for _, q in shared.value])
            for b in (b.slice(at, ALIKE_ROWS) for b in batches for at in range(0, b.num_rows, ALIKE_ROWS)):
                ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
                have, sizes = _letters(texts), np.array([len(t) for t in texts])
                for (qid, question), own in zip(shared.value, asked):
                    bound = 2 * np.minimum(have, own).sum(axis=1) / np.maximum(sizes + len(question), 1)
                    bound[sizes + len(question) == 0] = 1.0
                    for i in np.argsort(-bound, kind="stable").tolist():
                        score, other = best.get(qid, (-1.0, 0))
                        if bound[i] < score - 1e-12:
                            break
                        if ids[i] == qid:
                            continue
                        now = SequenceMatcher(None, question, texts[i]).ratio()
                        if now > score or now == score and ids[i] < other:
                            best[qid] = (now, ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([i for _, i in best.values()], pa.int64()),
                pa.array([100 * s for s, _ in best.values()], pa.float64())], ["qid", "id", "score"])

        got = base.select("id", "text").mapInArrow(work, "qid long, id long, score double")
        found = got if found is None else found.union(got)
    top = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id")))
    return found.groupBy("qid").agg(top.alias("b")).select("qid", "b.id", "b.score")
