"""Exact top-k over sparse vectors by inverted lists with bounds: common terms are only looked up for what can still win.

Weights are positive.  A term's bound for a query is the query's weight times the greatest weight that any document
has in it.  With a query's terms in order from rare to common, a document that has none but the last of them scores
less than the sum of their bounds; as soon as that is below what the k-th best has for certain, these terms' lists
need not be read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_path

#: A query's first floor comes from its rarest terms, as many as have so many entries for each of the k together.
SEED_ENTRIES = 50
#: Slices of a term's documents, so that one that most documents have is no single key.
SLICES = 16
#: Different terms of queries that a task holds at once, when it counts hits; more: several passes.
HELD_TERMS = 1_000_000


def _met(queries: DataFrame, docs: DataFrame, slices: int) -> DataFrame:
    """(qid, doc_id, score): sums over the terms of ``queries(qid, term, wq)`` in ``docs(doc_id, term, weight)``."""
    q = queries.select("qid", "term", "wq", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    d = docs.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))
    return q.join(d, ["term", "_slice"]).groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))


def kept(rows: DataFrame, kind: str) -> DataFrame:
    """rows, computed once: written and read again."""
    path = scratch_path(rows.sparkSession, kind)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bounded(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """queries(qid, term, weight) as (qid, term, wq, df, bound, seen, rest): by rising df, entries before, and bounds from here on."""
    stats = docs.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("most"))
    met = queries.select("qid", "term", F.col("weight").alias("wq")).join(stats, "term").withColumn("bound", F.col("wq") * F.col("most"))
    order = Window.partitionBy("qid").orderBy("df", "term")
    seen = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return met.drop("most").withColumn("seen", seen).withColumn("rest", F.sum("bound").over(order.rowsBetween(0, Window.unboundedFollowing)))


def candidates(terms: DataFrame, docs: DataFrame, k: int, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(qid, doc_id, score, floor) that may be among a query's k best, by terms that must be read; and the terms that need not."""
    seeds = _met(terms.where(F.col("seen") < SEED_ENTRIES * k), docs, slices)
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    floors = seeds.withColumn("_n", nth).where(F.col("_n") == k).select("qid", (F.col("score") * (1 - 1e-9)).alias("floor"))
    marked = terms.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    read, left = marked.where(F.col("rest") >= F.col("floor")), marked.where(F.col("rest") < F.col("floor"))
    more = left.groupBy("qid").agg(F.max("rest").alias("more"))
    floors = marked.groupBy("qid").agg(F.first("floor").alias("floor")).join(more, "qid", "left")
    scored = _met(read, docs, slices).join(floors, "qid")
    return scored.where(F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.col("floor")).select("qid", "doc_id", "score", "floor"), left


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): each query's k best of the documents that share a term with it, ties to the smaller id.

    ``queries(qid, term, weight)``, ``docs(doc_id, term, weight)``, weights positive, each term once in a vector.  digits:
    scores are rounded before they are compared.  What several steps read is written once.
    """
    docs = kept(docs.select("doc_id", "term", "weight"), "postings")
    terms = kept(bounded(queries, docs), "bounds")
    some, left = candidates(terms, docs, k)
    some, left = kept(some, "candidates"), kept(left, "unread")
    # what survives is looked up in the lists that weren't read
    hot = docs.join(left.select("term").distinct(), "term", "left_semi").join(some.select("doc_id").distinct(), "doc_id", "left_semi")
    more = some.select("qid", "doc_id").join(hot, "doc_id").join(left.select("qid", "term", "wq"), ["qid", "term"])
    more = more.groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("more"))
    score = F.col("score") + F.coalesce("more", F.lit(0.0))
    full = some.join(more, ["qid", "doc_id"], "left").withColumn("score", score if digits is None else F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")


def hit_counts(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, num_docs): how many of ``docs(doc_id, terms)``, one row a document, have a term of ``queries(qid, term)``.

    Each task holds, for each term of the queries, the queries that have it as bits, and adds up documents; no pair of
    query and document leaves it.  More than HELD_TERMS terms: several passes over the documents.
    """
    spark = docs.sparkSession
    pairs = kept(queries.select("qid", "term").distinct(), "hits")
    passes = max(1, -(-pairs.count() // HELD_TERMS))
    found = None
    for p in range(passes):
        some = pairs.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p).collect()
        ids = sorted({r.qid for r in some})
        if not ids:
            continue
        place, bits = {q: i for i, q in enumerate(ids)}, {}
        for r in some:
            bits[r.term] = bits.get(r.term, 0) | 1 << place[r.qid]
        shared = spark.sparkContext.broadcast((ids, bits))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, bits = shared.value
            total, size = np.zeros(len(ids), dtype=np.int64), -(-len(ids) // 8)
            for b in batches:
                for terms in b.column(0):
                    hit = 0
                    for t in terms.as_py() or ():
                        hit |= bits.get(t, 0)
                    if hit:
                        total += np.unpackbits(np.frombuffer(hit.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["qid", "num_docs"])

        got = docs.select("terms").mapInArrow(work, "qid long, num_docs long")
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], "qid long, num_docs long")
    return found.groupBy("qid").agg(F.sum("num_docs").alias("num_docs")).where("num_docs > 0")
