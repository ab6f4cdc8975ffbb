"""Operator 3: quality rules as weak supervision."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, pick, shared_path, small_batches

_SYMBOLS = b"#*$%&|<>"
_ENDS = (b".", b"!", b"?", b":", b";", b'"', "…".encode(), "”".encode(), "。".encode())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_digits", "n_marked_lines")
#: The window of repeated words, and the base rule.
WINDOW = 5
_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words of each document that lie in a WINDOW of words found twice or more in it.

    Windows are found by a 64-bit hash; those whose hash repeats are then compared word for word.
    """
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(docs, dtype=np.int64)
    word = ids.astype(np.uint64) + np.uint64(1)
    key = doc[:n].astype(np.uint64) * _C
    for j in range(WINDOW):
        key = key * _B + word[j : j + n]
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    key = key[inside]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(docs, dtype=np.int64)
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    places = inside[twice[at] == key]
    # exact: the windows themselves, in one order for all
    rows = np.column_stack([doc[places], *[ids[places + j] for j in range(WINDOW)]])
    order = np.lexsort(rows.T[::-1])
    rows, places = rows[order], places[order]
    same = (rows[1:] == rows[:-1]).all(axis=1)
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    covered = np.zeros(len(ids), dtype=bool)
    for j in range(WINDOW):
        covered[places[again] + j] = True
    return np.bincount(doc[covered], minlength=docs)


def measure(texts: list[str], size: int = 500_000) -> np.ndarray:
    """MEASURES of each text, one row each; about ``size`` characters are worked on at once."""
    out = np.zeros((len(texts), len(MEASURES)), dtype=np.int64)
    at = 0
    while at < len(texts):
        end, taken, words, lengths = at, 0, [], []
        while end < len(texts) and (end == at or taken + len(texts[end]) <= size):
            text = texts[end]
            taken += len(text)
            data = text.encode()
            own = data.split()
            words += own
            lengths.append(len(own))
            spaces = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
            lines = [x for x in data.split(b"\n") if x.strip()]
            ended = sum(x.rstrip().endswith(_ENDS) for x in lines)
            out[end, 0] = len(own)
            out[end, 1] = len(text) - spaces
            out[end, 2] = len(data) - len(data.translate(None, _SYMBOLS))
            out[end, 3] = len(lines) - len(set(lines))
            out[end, 5:] = len(lines), ended, len(set(own)), len(data) - len(data.translate(None, b"0123456789")), sum(len(x) > len(x.translate(None, _SYMBOLS)) for x in lines)
            end += 1
        numbers = defaultdict(count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(end - at), lengths)
        out[at:end, 4] = repeated_words(ids, doc, end - at)
        at = end
    return out


def with_measures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the MEASURES of its column ``text``; a text goes to Python once."""
    names = [*keep, *([] if text in keep else [text])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                m = measure([t.as_py() or "" for t in some.column(names.index(text))])
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(keep))], *[pa.array(m[:, i]) for i in range(len(MEASURES))]], [*keep, *MEASURES])
        give_back()

    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep] + [f"{m} long" for m in MEASURES]
    return docs.select(*names).mapInArrow(work, ", ".join(kinds))


def _vote(good, bad):
    """1: good, -1: bad, 0: abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict:
    """Each rule sees the measures of one text and votes or abstains."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    symbols, mean = F.col("n_symbols") / words, F.col("word_chars") / words
    repeated, duplicate = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    ended, distinct = F.col("n_ended_lines") / lines, F.col("n_distinct_words") / words
    digits = F.col("n_digits") / F.greatest("word_chars", F.lit(1))
    per_line, marked = F.col("n_words") / lines, F.col("n_marked_lines") / lines
    density = F.col("n_symbols") / F.greatest("word_chars", F.lit(1))
    return {
        "length": _vote(F.col("n_words") >= 50, F.col("n_words") < 10),
        # how many, by words and by characters, is one witness; on how many lines they stand is another
        "symbols": _vote((symbols < 0.02) & (density < 0.004), (symbols > 0.1) | (density > 0.025)),
        "marked_lines": _vote(marked == 0, marked > 0.3),
        "word_size": _vote((mean >= 2.5) & (mean <= 9), (mean < 2) | (mean > 12)),
        "repeats": _vote(repeated < 0.05, repeated > 0.2),
        "lines": _vote(duplicate == 0, duplicate > 0.3),
        "sentences": _vote(ended > 0.9, ended < 0.5),
        "variety": _vote(distinct > 0.25, distinct < 0.1),
        "digits": _vote(digits < 0.1, digits > 0.3),
        "layout": _vote(per_line >= 5, per_line < 2),
    }


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vote_code():
    """All votes as one number in base 3; there are 3 ** rules of them at most, whatever the corpus."""
    code = F.lit(0)
    for vote in rules().values():
        code = code * 3 + vote + 1
    return code.cast("int")


def fit(patterns: dict[int, int], steps: int = 200) -> dict[int, float]:
    """Posterior probability of good quality of each pattern of votes, by expectation-maximisation.

    Two classes; given the class, rules vote independently.  For each rule the two accuracies (a vote is
    right on good, on bad texts) are estimated; abstentions say nothing.  Texts that a rule calls bad
    start as bad with probability 0.9, others as good.  Accuracies stay at most 0.99; on good
    texts a rule is better than chance, and on bad ones it may be blind, but a vote for good never
    counts against it.  The share of good texts stays between 0.01 and 0.99.  Small pseudo-counts let
    any set of patterns, even one, have a result.
    """
    if not patterns:
        return {}
    m = len(rules())
    codes = np.array(sorted(patterns))
    weight = np.array([patterns[c] for c in codes], dtype=float)
    votes = np.stack([codes // 3**k % 3 - 1 for k in range(m - 1, -1, -1)], axis=1)
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    good = np.where(no.any(axis=1), 0.1, 0.9)
    for _ in range(steps):
        g, b = weight * good, weight * (1 - good)
        right_good = np.clip((g @ yes + 1.6) / (g @ (yes + no) + 2), 0.55, 0.99)
        right_bad = np.clip((b @ no + 1) / (b @ (yes + no) + 2), 1 - right_good, 0.99)
        share = float(np.clip((g.sum() + 1.8) / (weight.sum() + 2), 0.01, 0.99))
        odds = np.log(share / (1 - share)) + yes @ np.log(right_good / (1 - right_bad)) + no @ np.log((1 - right_good) / right_bad)
        before, good = good, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if abs(good - before).max() < 1e-9:
            break
    return {int(c): float(p) for c, p in zip(codes, good)}


def posteriors(coded: DataFrame) -> DataFrame:
    """(code, quality) of every pattern of votes in ``coded(code)``, null codes left out.

    Patterns are counted over all rows; only their counts reach the driver, 3 ** rules at most (59,049 rows of
    12 bytes), so the table may be broadcast whatever the corpus.
    """
    counts = coded.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()
    table = sorted(fit({r.code: r.n for r in counts}).items())
    return F.broadcast(coded.sparkSession.createDataFrame(table, "code int, quality double"))


def code_or_null():
    """vote_code, null where the base rule fails: such a text is bad already; were it counted, the bad class would be a picture of the rule."""
    return F.when(~base_failed(), vote_code())


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, quality and kept of every row of ``docs(doc_id, text)``.

    Null and empty texts have no words: every measure is 0, base_failed is true and kept false.
    Repeated rows give repeated rows; null ids pass through; an empty table gives an empty one; other
    columns are ignored.
    """
    measured = cut(with_measures(pick(docs, "doc_id", "text"), "text", ["doc_id"]).withColumn("code", code_or_null()))
    joined = measured.join(posteriors(measured.select("code")), "code", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return joined.withColumn("base_failed", F.col("code").isNull()).withColumn("kept", F.col("quality") >= 0.5).drop("code")


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, in all their columns.

    Each text is measured once: rows that the base rule leaves are written with their pattern of votes, and
    read again once the patterns' posteriors are known, so no text is shuffled.
    """
    spark, columns = docs.sparkSession, docs.columns
    small_batches(spark)
    own = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*own)
    path = shared_path(spark, "votes")
    with_measures(plain, f"c{columns.index('text')}", own).withColumn("code", code_or_null()).where("code is not null").select(*own, "code").write.parquet(path)
    voted = spark.read.parquet(path)
    return voted.join(posteriors(voted.select("code")), "code").where("quality >= 0.5").select(*own).toDF(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *MEASURES[:5], "base_failed", "kept", "quality")
