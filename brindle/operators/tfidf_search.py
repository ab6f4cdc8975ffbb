"""Exact top-k of documents by TF-IDF likeness of words and word pairs, without a table of all documents' terms.

A document's length needs the frequency of each of its terms, and there are several times as many (document, term) pairs
as bytes of text worth keeping.  So lengths are first bounded from below, by frequencies of hashed slots of terms (a
slot's is that of all its terms together, so no term's is higher); that bounds every score from above.  The best by
bound give each query a floor, and exact lengths are made for the documents whose bound reaches it, alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .maxscore import kept

#: Slots of the frequency table (8 MB, sent to the tasks), and bits of the filter of wanted terms (2 MB).
SLOTS, FILTER_BITS = 1 << 21, 1 << 24
#: Documents by bound that give a query its floor, for each of the k, and rows that a task scores at once.
SEEDS, AT_ONCE = 3, 500
#: Entries (query, term) that a task holds; of more, queries are searched in several passes.
HELD_ENTRIES = 1_000_000
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashed(docs: DataFrame, doc_id: str, words: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def _with_pairs(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of words in order, then of pairs of neighbours in a row."""
    x = words.view(np.uint64)
    pairs = (x[:-1] * _FIRST ^ x[:-1] >> np.uint64(29)) * _FIRST + x[1:] * _SECOND
    pairs = (pairs ^ pairs >> np.uint64(32)) * _FIRST
    same = rows[1:] == rows[:-1]
    return np.concatenate((rows, rows[1:][same])), np.concatenate((x, pairs[same])).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row, term, tf) of some documents at a time: each document's different terms, in order of row and term."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            some = b.slice(at, AT_ONCE)
            lists = some.column(1)
            sizes = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            rows, terms = _with_pairs(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy())
            order = np.lexsort((terms, rows))
            rows, terms = rows[order], terms[order]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
            firsts = np.flatnonzero(new)
            yield some.column(0), rows[firsts], terms[firsts], np.diff(np.append(firsts, len(rows)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, rows, terms, tf in _counted(batches):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(terms), pa.array(tf)], ["id", "term", "tf"])


def _frequencies(hashed: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents the terms of each slot are, added up, and each of the ``wanted`` terms (sorted)."""
    slots = SLOTS
    sent = hashed.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n = sent.value, np.zeros(slots + len(sent.value), dtype=np.int64)
        for _, _, terms, _ in _counted(batches):
            n[:slots] += np.bincount(terms & (slots - 1), minlength=slots)
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
                n[slots:] += np.bincount(at[wanted[at] == terms], minlength=len(wanted))
        some = np.flatnonzero(n)
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["slot", "n"])

    got = hashed.mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(slots + len(wanted), dtype=np.int64)
    n[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return n[:slots], n[slots:]


def _idf(df, n_docs: int):
    return np.log((1.0 + n_docs) / (1.0 + df)) + 1


class _Queries:
    """Some queries' weighted terms, looked up by term."""

    def __init__(self, ids: list[int], place: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.place, self.weight = ids, place[order], weight[order]
        self.terms, self.starts, self.sizes = np.unique(term[order], return_index=True, return_counts=True)

    def dots(self, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums of weight times tf, a row a document and a column a query."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        met = np.flatnonzero(self.terms[at] == terms)
        at, sizes = at[met], self.sizes[at[met]]
        entry = np.repeat(self.starts[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(met) else at
        cell = np.repeat(rows[met], sizes) * len(self.ids) + self.place[entry]
        return np.bincount(cell, self.weight[entry] * np.repeat(tf[met], sizes), n_rows * len(self.ids)).reshape(n_rows, -1)


def _lengths(hashed: DataFrame, found: DataFrame, n_docs: int) -> DataFrame:
    """(id, length) of the documents ``found(id)``: exact frequencies of their terms alone."""
    spark, bits = hashed.sparkSession, FILTER_BITS

    kind = hashed.schema["id"].dataType.simpleString()
    own = kept(hashed.join(found, "id", "left_semi").mapInArrow(_pairs, f"id {kind}, term long, tf long"), "found-terms")
    slots = own.select(F.pmod("term", F.lit(bits)).alias("bit")).distinct().toArrow().column(0).to_numpy()
    wanted = np.zeros(bits, dtype=bool)
    wanted[slots] = True
    sent = spark.sparkContext.broadcast(np.packbits(wanted, bitorder="little"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for _, _, terms, _ in _counted(batches):
            bit = terms & (bits - 1)
            some, n = np.unique(terms[held[bit >> 3] >> (bit & 7) & 1 == 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n)], ["term", "n"])

    df = hashed.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.col("tf") * (F.log((1.0 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)
    return own.join(df, "term").groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("length"))


def topk(queries: DataFrame, docs: DataFrame, k: int, words: Column, doc_id: str = "doc_id", query_id: str = "qid") -> tuple[DataFrame, DataFrame]:
    """(qid, doc_id, score, rank), each query's k best documents that share a term with it, ties to the smaller id; and (qid, num_docs), how many share one.

    Terms are ``words`` and pairs of neighbours, told by 64 bits of hash.  Weights are tf * idf over unit length, idf = ln((1 + n) / (1 + df)) + 1 by the documents; terms of none are dropped
    from the queries.  Ids differ between rows.  Every document is scored against every query in its task; what leaves
    a task are the best by bound, and those whose bound reaches the floor.
    """
    spark, n_docs = docs.sparkSession, docs.count()
    hashed = kept(_hashed(docs, doc_id, words), "words")
    asked = _hashed(queries, query_id, words).mapInArrow(_pairs, "id long, term long, tf long").toArrow()
    kind = hashed.schema["id"].dataType.simpleString()
    qid, term, tf = (asked.column(c).to_numpy() for c in ("id", "term", "tf"))
    wanted = np.unique(term)
    slots, exact = _frequencies(hashed, wanted)
    df = exact[np.searchsorted(wanted, term)] if len(term) else term
    qid, term, tf, df = (x[df > 0] for x in (qid, term, tf, df))
    raw = tf * _idf(df, n_docs)
    ids, place = np.unique(qid, return_inverse=True)
    # a document's weight has the idf too
    weight = raw * _idf(df, n_docs) / np.sqrt(np.bincount(place, raw * raw, len(ids)))[place] if len(ids) else raw
    none = spark.createDataFrame([], f"qid long, doc_id {kind}, score double, rank int"), spark.createDataFrame([], "qid long, num_docs long")
    if not len(ids):
        return none
    least_idf = spark.sparkContext.broadcast(_idf(slots, n_docs).astype(np.float32) * np.float32(1 - 1e-6))
    most = SEEDS * k

    def scored(queries, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(ids, dots, least lengths)."""
        low = least_idf.value
        for ids, rows, terms, tf in _counted(batches):
            w = tf * low[terms & (len(low) - 1)].astype(np.float64)
            yield ids, queries.dots(rows, terms, tf, len(ids)), np.sqrt(np.bincount(rows, w * w, len(ids))) + 1e-300

    tops, hits = [], []
    passes = max(1, -(-len(term) // HELD_ENTRIES))
    for p in range(passes):
        mine = place % passes == p
        of = np.unique(place[mine])
        sent = spark.sparkContext.broadcast(_Queries(ids[of].tolist(), np.searchsorted(of, place[mine]), term[mine], weight[mine]))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            n, heap = np.zeros(len(queries.ids), dtype=np.int64), [[] for _ in queries.ids]
            worst = np.zeros(len(queries.ids))
            for ids, dots, length in scored(queries, batches):
                n += (dots > 0).sum(axis=0)
                bound = dots / length[:, None]
                rows, cols = np.nonzero(bound > worst)
                for i, q in zip(rows.tolist(), cols.tolist()):
                    heap[q].append((bound[i, q], ids[i].as_py(), dots[i, q]))
                for q in set(cols.tolist()):
                    heap[q] = sorted(heap[q], key=lambda x: -x[0])[:most]
                    worst[q] = heap[q][-1][0] if len(heap[q]) == most else 0.0
            told = [(q, d, x, 0) for q, rows in zip(queries.ids, heap) for _, d, x in rows] + [(q, None, None, h) for q, h in zip(queries.ids, n.tolist()) if h]
            for i in range(0, len(told), 10_000):
                columns = list(zip(*told[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.int64())], ["qid", "id", "dot", "n"])

        id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        told = kept(hashed.mapInArrow(best, f"qid long, id {kind}, dot double, n long"), "seeds")
        hits.append(told.groupBy("qid").agg(F.sum("n").alias("num_docs")))
        seeds = told.where("dot is not null")
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
        by_score = seeds.join(_lengths(hashed, seeds.select("id").distinct(), n_docs), "id").withColumn("score", F.col("dot") / F.col("length"))
        floors = {r.qid: r.score * (1 - 1e-9) for r in by_score.withColumn("n", nth).where(F.col("n") == k).select("qid", "score").collect()}
        floor = spark.sparkContext.broadcast(np.array([floors.get(q, 0.0) for q in sent.value.ids]))

        def reaching(batches: Iterator[pa.RecordBatch], sent=sent, floor=floor) -> Iterator[pa.RecordBatch]:
            queries, least = sent.value, floor.value
            for ids, dots, length in scored(queries, batches):
                rows, cols = np.nonzero((dots > 0) & (dots >= least * length[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(queries.ids, dtype=np.int64)[cols]), ids.take(pa.array(rows)), pa.array(dots[rows, cols])], ["qid", "id", "dot"])

        some = kept(hashed.mapInArrow(reaching, f"qid long, id {kind}, dot double"), "candidates")
        full = some.join(_lengths(hashed, some.select("id").distinct(), n_docs), "id").withColumn("score", F.col("dot") / F.col("length"))
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        tops.append(full.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", F.col("id").alias("doc_id"), "score", "rank"))
    top, n = tops[0], hits[0]
    for a, b in zip(tops[1:], hits[1:]):
        top, n = top.union(a), n.union(b)
    return top, n


def most_frequent(docs: DataFrame, words: Column, most: int) -> DataFrame:
    """(term, idf) of the ``most`` most frequent words and pairs of neighbours in ``docs``, ties in term order.

    Occurrences are added up by hashed slots first: no term occurs more often than its slot.  Only terms of the slots
    that hold most are counted on their own; if the last of the best doesn't occur as often as the fullest slot that
    wasn't looked at, more slots are.  A row is a document.
    """
    spark, n_docs = docs.sparkSession, docs.count()
    hashed = kept(_hashed(docs, "doc_id", words), "words")
    slots = SLOTS

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, dtype=np.int64)
        for _, _, terms, tf in _counted(batches):
            n += np.bincount(terms & (slots - 1), tf, slots).astype(np.int64)
        some = np.flatnonzero(n)
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 100_000]), pa.array(n[some[i : i + 100_000]])], ["slot", "n"])

    got = hashed.mapInArrow(add_up, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(slots, dtype=np.int64)
    totals[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    wanted = 2 * most
    while True:
        least = int(np.sort(totals)[-min(wanted, slots)]) or 1
        sent = spark.sparkContext.broadcast(totals >= least)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            looked = sent.value
            for b in batches:
                for at in range(0, b.num_rows, AT_ONCE):
                    lists = b.column(1).slice(at, AT_ONCE)
                    sizes = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                    rows, first = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()
                    same = np.flatnonzero(rows[1:] == rows[:-1])
                    first, second = np.concatenate((first, first[same])), np.concatenate((np.zeros(len(first), np.int64), first[same + 1]))
                    pair = np.arange(len(first)) >= len(rows)
                    rows, terms = _with_pairs(rows, first[: len(rows)])
                    some = np.flatnonzero(looked[terms & (len(looked) - 1)])
                    order = some[np.lexsort((rows[some], terms[some]))]
                    rows, terms = rows[order], terms[order]
                    if not len(terms):
                        continue
                    new = np.append(True, terms[1:] != terms[:-1])
                    firsts = np.flatnonzero(new)
                    df = np.add.reduceat(new | np.append(True, rows[1:] != rows[:-1]), firsts, dtype=np.int64)
                    one = order[firsts]
                    yield pa.RecordBatch.from_arrays([pa.array(terms[firsts]), pa.array(first[one]), pa.array(second[one], mask=~pair[one]), pa.array(df),
                        pa.array(np.diff(np.append(firsts, len(terms))))], ["hash", "first", "second", "df", "total"])

        sums = hashed.mapInArrow(count, "hash long, first long, second long, df long, total long").groupBy("hash").agg(F.first("first").alias("first"),
            F.first("second").alias("second"), F.sum("df").alias("df"), F.sum("total").alias("total"))
        sums = kept(sums, "counted")
        last = sums.orderBy(F.desc("total")).limit(most).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
        if least == 1 or wanted >= slots or last.n == most and last.total >= least:
            break
        wanted *= 4
    best = sums.where(F.col("total") >= (last.total if last.n == most else 0))
    known = best.select(F.explode(F.array("first", "second")).alias("h")).where("h is not null").distinct()
    spelt = docs.select(F.explode(F.array_distinct(words)).alias("word")).withColumn("h", F.xxhash64("word")).join(F.broadcast(known), "h").distinct()
    spelt = kept(spelt, "spelt")
    named = best.join(spelt.select(F.col("h").alias("first"), F.col("word").alias("a")), "first").join(spelt.select(F.col("h").alias("second"), F.col("word").alias("b")), "second", "left")
    term = F.when(F.col("second").isNull(), F.col("a")).otherwise(F.concat("a", F.lit(" "), "b"))
    top = named.select(term.alias("term"), "df", "total").orderBy(F.desc("total"), "term").limit(most)
    return top.select("term", (F.log((1.0 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))
