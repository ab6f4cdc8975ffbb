"""Queries that tell languages apart, and words in texts without spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segment
from ..operators import language
from ..sources.tables import table

#: Words of the dictionary that segmentation is given.
DICTIONARY = 20_000
#: Letters of the invented prose, whose spaces are left out.
LETTERS = "a-zà-öø-ÿ"


def detected_languages(s, d):
    """(lang, n, ok): for each labelled language how many documents it has, and whether 95 % of them are told to be in it."""
    docs = table(s, d, "documents")
    marked = language.detected(docs.where("lang is not null"), language.fit(docs))
    return marked.groupBy("lang").agg(F.count("*").alias("n"), (F.avg((F.col("language") == F.col("lang")).cast("int")) >= 0.95).alias("ok"))


def clean_paragraphs(s, d):
    """(doc_id, n, chars): the cleaned paragraphs of each document that are in English, or in no language known."""
    docs = table(s, d, "documents")
    kept = language.clean_paragraphs(docs.select("doc_id", "text"), language.fit(docs), ["en"], is_html=False)
    chars = F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.length(p))
    return kept.select("doc_id", F.size("paragraphs").alias("n"), chars.alias("chars"))


def _dictionary(s, d) -> dict[str, int]:
    words = table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("w"))
    return {r.w: r.n for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()}


def segmented_words(s, d):
    """(item_id, words): each benchmark item without its spaces, cut into words by the documents' most frequent ones."""
    items = table(s, d, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), " ", "").alias("t"))
    return items.select("item_id", F.array_join(segment.segmented(s, "t", _dictionary(s, d), unspaced=LETTERS), " ").alias("words"))


QUERIES = {
    "detected_languages": (detected_languages, "SELECT lang, count(*) AS n, true AS ok FROM documents WHERE lang IS NOT NULL GROUP BY lang"),
    "clean_paragraphs": (clean_paragraphs, None),
    "segmented_words": (segmented_words, None),
}
