"""Columns that SQL can express, against DuckDB; the mix word for word; and awkward texts and keys."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, grammar, licences, mixing, packing, quality, simhash, token_counts, winnowing

from ..compare import duck_rows, spark_rows

QUALITY = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m"""

LICENCES = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT string_split(a, ' ') AS p, b AS label FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) t(a, b)),
h AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) + 1)) AS i FROM d, p) WHERE w[i : i + len(p) - 1] = p),
a AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN a USING (doc_id)"""


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_quality_columns(docs, data):
    assert spark_rows(quality.quality(docs).select("doc_id", *quality.MEASURES[:5], "base_failed")) == duck_rows(QUALITY, data)


def test_licence_columns(docs, data):
    assert spark_rows(licences.licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == duck_rows(LICENCES, data)


def test_targets_by_level(docs):
    """The level L at which the least of 3 * size and L * weight add up to all words, found by halving."""
    rows = mixing.mixed_words(docs).collect()
    names = {r.doc_id: r.source for r in docs.collect()}
    size, target = Counter(), {}
    for r in rows:
        size[names[r.doc_id]] += r["size"]
        target[names[r.doc_id]] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5.0, 2.0, 1.0] * len(order)))
    low, high = 0.0, 3.0 * sum(size.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * size[s], level * weight[s]) for s in order) < sum(size.values()) else (low, level)
    assert all(abs(target[s] - min(3 * size[s], high * weight[s])) < 1e-3 for s in order)


def test_words_taken(docs):
    """Every word of a source has one place; each slot takes the words of its block, one by one."""
    rows = mixing.sized(docs).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    parts, mix = mixing.mixture(rows)
    places, owners = defaultdict(set), defaultdict(dict)
    for r in parts.collect():
        for k in range(r.n_words if r["size"] else 0):
            at = (r.block, r.offset + k)
            assert at not in owners[r.s]
            owners[r.s][at] = r.doc_id
            places[r.s].add(at[0] * mixing.BLOCK_WORDS + at[1])
    assert all(p == set(range(len(p))) for p in places.values())
    taken = Counter()
    for r in mix.collect():
        for k in range(r.words):
            if (r.block, k) in owners[r.s]:
                taken[owners[r.s][r.block, k]] += 1
    assert taken == Counter({r.doc_id: r.taken for r in mixing.mixed_words(docs).collect() if r.taken})


def test_very_long_texts(spark):
    """A text of megabytes goes through every operator."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(600_000))
    df = spark.createDataFrame([(1, text, "a"), (2, "x" * 2_000_000, "a"), (3, "\n" * 1_000_000, "b"), (4, " under the mit license" * 50_000, None)],
        "doc_id long, text string, source string")
    assert {r.doc_id: r.n_words for r in quality.quality(df).collect()} == {1: 600_000, 2: 1, 3: 0, 4: 200_000}
    assert {r.doc_id: r.n_base for r in licences.licences(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 50_000}
    tokens = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
    pieces = packing.pack(df).collect()
    assert tokens[1] > 600_000 and sum(r.length for r in pieces if r.doc_id == 1) > 600_000 and max(r.length for r in pieces) == 2048
    assert len({r.component_id for r in simhash.near_duplicates(df).collect()}) == 4 and winnowing.fingerprints(df).count() == 4
    assert sum(r["size"] for r in mixing.mixed_words(df).collect()) == 800_001


def test_keys_of_other_types(spark):
    for kind in ("smallint", "int", "string"):
        df = spark.createDataFrame([("1", "some words of a text", "a"), (None, "no id", None), ("2", None, "a")],
            "doc_id string, text string, source string").withColumn("doc_id", F.col("doc_id").cast(kind))
        for operator in (licences.licences, quality.quality, token_counts.token_counts, packing.pack, simhash.near_duplicates, mixing.mixed_words):
            out = operator(df)
            assert out.count() == 3 and out.schema["doc_id"].dataType.simpleString() == kind
        turns = spark.createDataFrame([("7", "1", "user", "x"), ("7", "2", "user", "y")], "conv_id string, turn string, role string, text string")
        turns = turns.withColumn("conv_id", F.col("conv_id").cast(kind)).withColumn("turn", F.col("turn").cast(kind))
        assert chat.repaired(turns).schema["conv_id"].dataType.simpleString() == kind and chat.repaired(turns).count() == 2


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    grammar.write_tokens(empty, str(tmp_path / "none"))
    assert grammar.stored_tokens(spark, str(tmp_path / "none")).count() == 0


def test_packing_ties_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "same words here")] * 40 + [(5, "same words here")] * 40 + [(None, None)] * 3, "doc_id long, text string").repartition(5)
    seqs = defaultdict(list)
    rows = packing.pack(df).collect()
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 83 and len(seqs) == 1 and all(o == sum(n for _, n in sorted(p)[:i]) for p in seqs.values() for i, (o, _) in enumerate(sorted(p)))


def test_posteriors_meet_rows_by_join(docs):
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and np.isfinite([r.quality for r in quality.quality(docs).collect()]).all()


def test_rows_without_ids_are_spread(spark, tmp_path):
    """A third of all rows without an id, and rows that repeat one id: neither is one task's."""
    df = spark.createDataFrame([(None if i % 3 else 7, f"text {i} of many", "a") for i in range(3000)], "doc_id long, text string, source string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        grammar.write_tokens(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = spark.read.parquet(str(tmp_path / "t"))
    assert parts.count() >= 4 and max(r.n_tokens for r in parts.collect()) < 0.5 * sum(r.n_tokens for r in parts.collect())
    got = sorted(grammar.stored_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2000 + [7] * 1000 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    order = ["doc_id", "size", "text_hash"]
    slices = mixing.sized(df).select(F.pmod(F.xxhash64(*order), F.lit(16)).alias("s")).groupBy("s").count().collect()
    assert len(slices) == 16 and max(r["count"] for r in slices) < 400
    taken = mixing.mixed_words(df).collect()
    assert len(taken) == 3000 and all(r.taken <= 3 * r["size"] for r in taken)
    rows = packing.pack(df).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 3000 and all(o == sum(n for _, n in sorted(p)[:i]) for p in places.values() for i, (o, _) in enumerate(sorted(p)))
