"""TF-IDF vectors as rows, and retrieval over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, WS_RUN, let

#: Weights of a knowledge base that a task holds, 20 bytes each and a term's text.
HELD_WEIGHTS = 2_000_000


def folded(text: Column | str) -> Column:
    """The text in lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), WS_RUN, " ")


def char_grams(text: Column | str, low: int = 1, high: int = 3) -> Column:
    """All character n-grams of the lower-cased text, runs of white space as one space."""

    def grams(t: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(folded(text), lambda t: F.concat(*[grams(t, n) for n in range(low, high + 1)]))


def words(text: Column | str) -> Column:
    """Words of the lower-cased text, split at white space."""
    return F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), f"{WS}+"), lambda w: w != "")


def word_grams(text: Column | str) -> Column:
    """Words of the lower-cased text, split at white space, and pairs of neighbours."""

    def both(w: Column) -> Column:
        after = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        pairs = F.zip_with(w, after, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))

    return let(words(text), both)


def term_counts(docs: DataFrame, doc_id: str, grams: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit(counts: DataFrame, n_docs: int, max_features: int | None = None) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1; of too many terms the most frequent, ties in term order."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms.select("term", (F.log((1.0 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, weight) of unit length; terms unseen in the fit are dropped."""
    raw = counts.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(lengths, "id").select("id", "term", (F.col("w") / F.col("length")).alias("weight"))


def best_likeness(idf: DataFrame, weights: DataFrame, low: int = 1, high: int = 3) -> Callable[[Column | str], Column] | None:
    """The likeness of a text's character n-grams to the most like of a small base, null where they share none; None for a base of more than HELD_WEIGHTS weights.

    ``idf(term, idf)`` and ``weights(doc_id, term, weight)`` of the base, no more than HELD_WEIGHTS rows each, are sent to the
    tasks; a text's terms are counted and multiplied in its row, so texts are read once and nothing is shuffled.
    """
    rows = weights.select("doc_id", "term", "weight").limit(HELD_WEIGHTS + 1).collect()
    if len(rows) > HELD_WEIGHTS:
        return None
    fitted = sorted((r.term, r.idf) for r in idf.collect())  # each is a term of the base
    place = {t: i for i, (t, _) in enumerate(fitted)}
    item = {d: i for i, d in enumerate(sorted({r.doc_id for r in rows}))}
    rows.sort(key=lambda r: place[r.term])
    ends = np.cumsum(np.bincount([place[r.term] for r in rows], minlength=len(fitted)))
    arrays = (np.array([x for _, x in fitted]), ends, np.array([item[r.doc_id] for r in rows], np.int32), np.array([r.weight for r in rows], float))
    shared = weights.sparkSession.sparkContext.broadcast((place, *arrays))

    def best(text: str | None) -> float | None:
        place, idf, ends, items, weight = shared.value
        found = Counter(i for n in range(low, high + 1) for j in range(len(text or "") - n + 1) if (i := place.get(text[j : j + n])) is not None)
        if not found:
            return None
        terms = np.fromiter(found, np.int64, len(found))
        w = np.fromiter(found.values(), float, len(found)) * idf[terms]
        n = ends[terms] - np.where(terms > 0, ends[terms - 1], 0)
        # the lists of these terms, one behind the other
        at = np.arange(n.sum()) + np.repeat(ends[terms] - np.cumsum(n), n)
        return float(np.bincount(items[at], np.repeat(w, n) * weight[at]).max() / np.sqrt(w @ w))

    @F.pandas_udf("double")
    def likeness(texts: pd.Series) -> pd.Series:
        return pd.Series([best(t) for t in texts], dtype=object)

    return lambda text: likeness(folded(text))


def signals(ranked: DataFrame, hits: DataFrame, queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(qid, max_score, avg_topk, num_docs, context_len) from the k best (qid, doc_id, score) and the hits (qid, num_docs).

    Documents that share no term with a query have score 0; they fill a top k that is short, in order of id.  avg_topk
    is the mean of the positive scores in the top k; num_docs counts positive scores over all documents.
    """
    top = ranked.where("score > 0").select("qid", "doc_id", "score")
    # fillers: the first documents by id that aren't hits; k + k of them are enough
    fill = texts.orderBy("doc_id").limit(2 * k)
    short = queries.join(top.groupBy("qid").agg(F.count("*").alias("n_top")), "qid", "left").select("qid", F.coalesce("n_top", F.lit(0)).alias("n_top")).where(F.col("n_top") < k)
    spare = short.join(F.broadcast(fill.select("doc_id")), F.lit(True)).join(top.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    spare = spare.withColumn("r",
        F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).where(F.col("r") + F.col("n_top") <= k).select("qid", "doc_id",
        F.lit(0.0).alias("score"))
    chosen = top.union(spare).join(texts.select("doc_id", F.length("text").alias("chars")), "doc_id")
    out = chosen.groupBy("qid").agg(F.max("score").alias("max_score"), F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))),
        F.lit(0.0)).alias("avg_topk"), F.sum("chars").alias("context_len"))
    num_docs = F.coalesce("num_docs", F.lit(0)).cast("long").alias("num_docs")
    return out.join(hits, "qid", "left").select("qid", "max_score", "avg_topk", num_docs, F.col("context_len").cast("long"))


#: Route to the knowledge base when its best score, or the mean of the best, reaches these.
MAX_SCORE, MEAN_SCORE = 0.30, 0.12


def route(rows: DataFrame, max_score: float = MAX_SCORE, mean_score: float = MEAN_SCORE) -> DataFrame:
    """rows with target (kb or small_model) and reason."""
    kb = ((F.col("max_score") >= max_score) | (F.col("avg_topk") >= mean_score)) & (F.col("num_docs") >= 1)
    target = F.when(kb, "kb").otherwise("small_model")
    return rows.withColumn("target", target).withColumn("reason", F.format_string("max=%.2f avg=%.2f docs=%d → %s", "max_score", "avg_topk", "num_docs", "target"))
