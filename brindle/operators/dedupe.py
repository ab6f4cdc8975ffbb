"""Duplicates, new rows, overlaps, versions and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, strip
from .numbering import numbered


def first_of_each(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key.  Only (key, order) is grouped before rows meet, so copies cost one row a task."""
    hashed = docs.withColumn("_key", key)
    first = hashed.groupBy("_key").agg(F.min(order).alias(order))
    return hashed.join(first, ["_key", order], "left_semi").drop("_key")


def first_ids(docs: DataFrame, key: Column, order: str) -> DataFrame:
    """The smallest ``order`` of each key alone: each text is hashed once, and nothing is joined."""
    return docs.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)


def new_texts(incoming: DataFrame, existing: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Incoming rows whose normalised text is neither there nor earlier in the batch, with text_hash."""
    hashed = incoming.withColumn("text_hash", content_hash(text))
    known = existing.select(content_hash(text).alias("text_hash"))
    return first_of_each(hashed.join(known, "text_hash", "left_anti"), F.col("text_hash"), order)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())])))
def _first_lines(texts: pd.Series, least: pd.Series) -> pd.Series:
    out = []
    for text, min_chars in zip(texts, least):
        first: dict[str, int] = {}
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip()
            if len(line) >= min_chars:
                first.setdefault(line, pos)
        out.append([{"pos": p, "text": t} for t, p in first.items()])
    return pd.Series(out)


def distinct_paragraphs(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, pos, text): the lines of each document, stripped, long enough, and first of their kind in it.

    A document's lines never leave its row, so nothing is shuffled.
    """
    return docs.select("doc_id", F.explode(_first_lines("text", F.lit(min_chars))).alias("p")).select("doc_id", "p.pos", "p.text")


def keep_languages(docs: DataFrame, keep: list[str], column: str = "lang") -> DataFrame:
    """Rows in these languages, of none known, or all where no language is asked for; zh and en take their variants."""
    code = F.lower(F.coalesce(F.col(column), F.lit("unknown")))
    folded = F.when(code.startswith("zh"), "zh").when(code.startswith("en"), "en").otherwise(code)
    wanted = sorted({("zh" if k.lower().startswith("zh") else "en" if k.lower().startswith("en") else k.lower()) for k in keep})
    return docs if not wanted else docs.where(folded.isin(*wanted, "unknown"))


def overlap_ratio(left: DataFrame, right: DataFrame, key: str, alarm: float = 0.30) -> DataFrame:
    """One row (n_left, n_common, ratio, alarm): how many distinct keys of left are in right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    marked = a.join(b.withColumn("_hit", F.lit(1)), key, "left")
    total = marked.agg(F.count("*").alias("n_left"), F.count("_hit").alias("n_common"))
    ratio = F.when(F.col("n_left") > 0, F.col("n_common") / F.col("n_left")).otherwise(0.0)
    return total.withColumn("ratio", ratio).withColumn("alarm", ratio > alarm)


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change): added, removed, changed or same."""
    a = old.select(F.col(key), F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), F.col(value).alias("new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "old", "new", change.alias("change"))


def changes(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """rows with previous and changed: the value before, per key; a first value is a change."""
    w = Window.partitionBy(*key).orderBy(*order)
    previous = F.lag(value).over(w)
    return rows.withColumn("previous", previous).withColumn("changed", ~F.col(value).eqNullSafe(F.col("previous")))


def version_parts(c: Column | str) -> Column:
    """A dotted version as numbers; arrays of them compare as versions do."""
    return F.transform(F.split(F.col(c) if isinstance(c, str) else c, r"\."), lambda x: x.cast("int"))


def last_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def seeded_sample(rows: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows in an order fixed by the seed: the same rows on every run and partitioning."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("sample_key", mixed).orderBy("sample_key", key).limit(n)


def split_by_key(rows: DataFrame, key: str, seed: str, held_out: int = 10) -> DataFrame:
    """rows with split: eval for about one in ``held_out``, train for others, by the key's hash alone."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(held_out))
    return rows.withColumn("split", F.when(bucket == 0, "eval").otherwise("train"))


def new_slice(kb: DataFrame, order: str, exported: int, since: int | None = None, force_all: bool = False) -> DataFrame:
    """Rows of a knowledge base that an export takes: all if forced, else the last ``since``, else those behind the first ``exported``.

    Rows are numbered by ``order`` (numbers), without a task that sees them all.
    """
    if force_all:
        return kb
    if since is not None:
        return kb.orderBy(F.desc(order)).limit(max(0, since))
    return numbered(kb, order, "_n").where(F.col("_n") > exported).drop("_n")


def drifted(rows: DataFrame, similarity: Column, least: float = 0.95) -> DataFrame:
    """rows with drift: whether the new version's likeness to the old is below ``least``."""
    return rows.withColumn("drift", similarity < least)


def mixed_sample(answerable: DataFrame, unanswerable: DataFrame, key: str, total: int = 300, share: float = 0.25, seed: str = "s") -> DataFrame:
    """(…, answerable): ``share`` of ``total`` rows without an answer and the rest with one, or all there are, in an order fixed by the seed."""
    without = int(total * share)
    parts = [seeded_sample(df, n, key, seed).withColumn("answerable", F.lit(is_one)) for df, n, is_one in ((answerable, total - without, True), (unanswerable, without, False))]
    return parts[0].unionByName(parts[1])


def answer_split(sample: DataFrame, answerable: Column) -> DataFrame:
    """One row (total, n_answerable, n_unanswerable, pct_answerable, pct_unanswerable)."""
    n = sample.agg(F.count("*").alias("total"), F.count_if(answerable).alias("n_answerable"))
    pct = lambda c: F.when(F.col("total") > 0, 100.0 * c / F.col("total")).otherwise(0.0)
    return n.withColumn("n_unanswerable", F.col("total") - F.col("n_answerable")).select("*", pct(F.col("n_answerable")).alias("pct_answerable"),
        pct(F.col("n_unanswerable")).alias("pct_unanswerable"))


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of files(path, hash) whose hash isn't the one in seen(path, hash): what a gated run rebuilds."""
    return files.join(seen.select("path", F.col("hash").alias("_seen")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("_seen"))).drop("_seen")


def fired_by_mtime(files: DataFrame, cursor: DataFrame) -> DataFrame:
    """(path, mtime, run_key) of files changed after the cursor(path, last); the run's key is the time of the change."""
    joined = files.join(cursor, "path", "left").where(F.col("mtime") > F.coalesce("last", F.lit(0).cast("long")))
    return joined.select("path", "mtime", F.col("mtime").cast("string").alias("run_key"))


def asked(requests: DataFrame, question: str) -> DataFrame:
    """requests with status: 400 for a question that is null or white space, else 200."""
    empty = F.coalesce(strip(question), F.lit("")) == ""
    return requests.withColumn("status", F.when(empty, 400).otherwise(200))
