"""Operator 13: how far the sources of a language differ in their words, by sorted runs of (lang, term, source, document)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, pick, shared_path

LEAST_DOCS, TERM_RANKS, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Different terms of a task's groups that are counted before they are sent.
HELD = 250_000
#: Sources that are compared at once, and terms.
TILE, CHUNK = 128, 512
#: A-Z to a-z; other letters and all bytes beyond ASCII stay; all else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _runs(docs: DataFrame) -> DataFrame:
    """key (lang, a zero byte, term), source, document, n_docs, n: runs of documents that a task has met together.

    A document lies in one run of each of its terms; document is the first one's number, and only orders runs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        held = document = number = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (words, docs) in groups.items():
                start = lang.encode() + b"\0"
                keys = pa.array([start + w for w in words], pa.binary())
                n = len(keys)
                columns = [keys, pa.array([source] * n, pa.string()), pa.array(np.full(n, document)), pa.array(map(docs.__getitem__, words),
                    pa.int64(), size=n), pa.array(words.values(), pa.int64(), size=n)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "source", "document", "n_docs", "n"])
            groups.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = (text.as_py() or "").encode().translate(_TERMS).split()
                words, docs = groups[lang, source]
                held -= len(words)
                words.update(found)
                docs.update(set(found))
                held += len(words)
                number += 1
                if held >= HELD:
                    yield from sent()
                    held, document = 0, number
        yield from sent()
        give_back()

    return docs.mapInArrow(work, "key binary, source string, document long, n_docs long, n long")


def _changes(*columns: pa.Array) -> np.ndarray:
    """The places where any of the columns differs from the row before, and 0."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n, total (of all sources) and first (1 on one row of a term) of each term in enough documents of its language.

    Tasks send their runs to the term's partition, where they are sorted by (lang, term, source, document) and read
    once: the run of a term ends with its document frequency, and rare terms go no further.  A term sends a row for
    each source a task has met since it last sent, so that one in every document is no more than others.
    """
    ordered = _runs(docs).repartition("key").sortWithinPartitions("key", "source", "document").select("key", "source", "n_docs", "n")
    names = ["lang", "term", "source", "n", "total", "first"]

    def row(key: bytes, sources: dict[str, int]) -> pa.RecordBatch:
        lang, term = key.rsplit(b"\0", 1)
        k = len(sources)
        columns = [pa.array([x.decode()] * k, pa.string()) for x in (lang, term)] + [pa.array(list(sources), pa.string()),
            pa.array(list(sources.values()), pa.int64()), pa.array([sum(sources.values())] * k, pa.int64()), pa.array([1] + [0] * (k - 1), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_docs, open_sources = None, 0, {}
        for b in batches:
            if not b.num_rows:
                continue
            keys, sources, n_docs, n = b.column(0), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
            inner = _changes(keys, sources)
            counts = np.add.reduceat(n, inner)
            keys, sources = keys.take(pa.array(inner)), sources.take(pa.array(inner))
            docs_of = np.add.reduceat(n_docs, inner)
            terms = _changes(keys)
            ends = np.append(terms[1:], len(inner))
            frequency, totals = np.add.reduceat(docs_of, terms), np.add.reduceat(counts, terms)
            last = len(terms) - 1
            for i in sorted({0, last}):  # terms that batches may part
                key = keys[int(terms[i])].as_py()
                if key != open_key:
                    if open_docs >= least_docs:
                        yield row(open_key, open_sources)
                    open_key, open_docs, open_sources = key, 0, {}
                open_docs += int(frequency[i])
                for s, c in zip(sources.slice(terms[i], ends[i] - terms[i]).to_pylist(), counts[terms[i] : ends[i]].tolist()):
                    open_sources[s] = open_sources.get(s, 0) + c
            full = np.flatnonzero(frequency >= least_docs)
            full = full[(full > 0) & (full < last)]
            sizes = ends[full] - terms[full]
            if len(full):
                rows = np.repeat(terms[full] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
                named = [k.rsplit(b"\0", 1) for k in keys.take(pa.array(terms[full])).to_pylist()]
                first = np.zeros(len(rows), dtype=np.int32)
                first[np.append(0, np.cumsum(sizes)[:-1])] = 1
                of = pa.array(np.repeat(np.arange(len(full)), sizes))
                columns = [pa.array([x[j].decode() for x in named], pa.string()).take(of) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, sources.take(pa.array(rows)), pa.array(counts[rows]), pa.array(np.repeat(totals[full], sizes)), pa.array(first)], names)
        if open_docs >= least_docs:
            yield row(open_key, open_sources)

    return ordered.mapInArrow(scan, "lang string, term string, source string, n long, total long, first int")


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    quotient = F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * terms))
    return F.when(terms > 0, quotient + 1)


def _differences(scored: DataFrame, groups: DataFrame, slices: int) -> DataFrame:
    """lang, a, b (places of sources, a < b) and d: over terms, |p - p'| less what it is without the terms' counts.

    Terms' rows and each source's p without counts meet by language, pair of tiles of sources, and slice of terms.
    """
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)

    def paired(rows: DataFrame, *more) -> DataFrame:
        own = F.floor(F.col("place") / TILE).cast("int")
        every = rows.select("lang", "place", own.alias("own"), F.explode(tiles).alias("other"), *more)
        return every.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other")

    counted = paired(scored, F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"), "term", "p")
    heads = paired(groups, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    by = ["lang", "low", "high", "slice"]
    ordered = counted.unionByName(heads).repartition(*by).sortWithinPartitions(*by, F.asc_nulls_first("term")).select(*by, "term", "place", "p")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, plain, total, open_rows = None, None, [], None, []

        def add(rows: list[tuple[str, int, int]]) -> None:
            """Adds terms' rows to the sums, CHUNK terms at a time; a term's rows come together."""
            nonlocal total
            base = np.array([p for _, p in plain], dtype=np.int64)
            if total is None:
                total = np.zeros((len(base), len(base)), dtype=np.int64)
            terms: dict[str, int] = {}
            block = np.tile(base, (CHUNK, 1))
            for t, place, p in rows:
                block[terms.setdefault(t, len(terms)), places[place]] = p
            block = block[: len(terms)]
            for i in range(len(base) - 1):
                total[i, i + 1 :] += np.abs(block[:, i + 1 :] - block[:, i : i + 1]).sum(axis=0) - len(terms) * np.abs(base[i + 1 :] - base[i])

        def done() -> Iterator[pa.RecordBatch]:
            if open_rows:
                add(open_rows)
            if total is not None:
                low, high = now[1], now[2]
                at = np.array([x for x, _ in plain])
                i, j = np.nonzero(total)
                a, b = np.minimum(at[i], at[j]), np.maximum(at[i], at[j])
                own = (a // TILE == low) & (b // TILE == high)  # pairs inside one tile belong to the tile with itself
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * int(own.sum()), pa.string()), pa.array(a[own], pa.int32()), pa.array(b[own],
                    pa.int32()), pa.array(total[i, j][own])], ["lang", "a", "b", "d"])

        last, held = None, 0
        for b in batches:
            for *key, term, place, p in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    yield from done()
                    now, places, plain, total, open_rows, last, held = key, {}, [], None, [], None, 0
                if term is None:
                    places[place] = len(plain)
                    plain.append((place, p))
                    continue
                if term != last and held == CHUNK:
                    add(open_rows)
                    open_rows, held = [], 0
                held += term != last
                last = term
                open_rows.append((term, place, p))
        yield from done()

    return ordered.mapInArrow(work, "lang string, a int, b int, d long").groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: sources by how far they are from each other, and each source's own terms.

    ``docs(text, lang, source)``: nulls are read as ''; every row is a document, so repeated rows count each, and ids
    don't matter; ties go by the item's UTF-8; groups without a kept term are there with values 0 or by the prior
    alone; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    named = pick(docs, "lang", "source", "text")
    filled = named.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    path = shared_path(spark, "terms")
    kept_terms(filled, least_docs).write.parquet(path)
    kept = spark.read.parquet(path)
    langs = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = F.lit(0).cast("long")
    groups = filled.select("lang", "source").distinct().join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("terms", "lang_n", "own_n")])
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("p0", _p(zero, F.col("own_n"), F.col("terms")))
    groups = groups.withColumn("tiles", F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int"))
    path = shared_path(spark, "groups")
    groups.write.parquet(path)
    groups = spark.read.parquet(path)
    scored = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("own_n"), F.col("terms"))).withColumn("q", _p(F.col("total"),
        F.col("lang_n"), F.col("terms")))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    differences = _differences(scored, groups.where("terms > 0"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("p0").alias("other_p0"))
    pairs = groups.join(other, "lang").where("place <> other").withColumn("a", F.least("place", "other")).withColumn("b", F.greatest("place", "other"))
    value = F.coalesce(F.col("terms") * F.abs(F.col("p0") - F.col("other_p0")), zero) + F.coalesce("d", zero)
    pairs = ranked(pairs.join(differences, ["lang", "a", "b"], "left").withColumn("value", value), "pair")
    terms = ranked(scored.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term")
    return pairs.unionByName(terms.where(F.col("rank") <= term_ranks))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS terms, sum(total) AS lang_n FROM k GROUP BY lang),
c AS (SELECT lang, term, source, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, sum(n) AS own_n FROM c GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(o.own_n, 0) + 5 * l.terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (l.lang_n + 5 * l.terms)::HUGEINT AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN o ON o.lang = g.lang AND o.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM n WHERE part = 'pair' OR rank <= 50
"""
