"""Operators 11, 12 and 13 against brute force, and on awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import divergence, hard_negatives, shortest_pack

from ..compare import duck_rows, spark_rows

# 11


def negatives(rows):
    """The contract, row by row."""
    part = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        part.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for at, (a, label, v) in enumerate(part):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, k) for n, (i, k, w) in enumerate(part) if n != at]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 30 * ps <= 100 * x[0] <= 90 * ps][:10]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    return sorted(map(tuple, hard_negatives.hard_negatives(df).collect()), key=str)


def test_hard_negatives_equal_sql(spark, data):
    assert spark_rows(hard_negatives.query(spark, data)) == duck_rows(hard_negatives.SQL, data)


def test_hard_negatives_of_small_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(25 * i, rng.choice([1, 1, 1, 2, 3]), [rng.choice([0.0, 0.5, -0.25, 1.0]) + rng.random() * (i % 3) for _ in range(4)]) for i in range(400)]
    rows += [rows[0]] * 30 + [rows[16]] * 20  # repeated rows, an anchor's among them
    for name, value in (("BLOCK_ROWS", 16), ("MEET", 3), ("LEAVES", 8), ("SAMPLE_ROWS", 64)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [(i, k, [float(np.float32(x)) for x in v]) for i, k, v in rows]
    assert mined(spark, rows) == negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (100, 2, [1.0]), (200, 1, []), (None, 1, [3.0, 1.0]), (None, 2, [0.5, 0.75]), (1, None, [1.0, 1.0]), (2, 1, None), (3,
        1, [None, 1.0]), (4, 1, [nan, 1.0]), (300, 1, [inf, 1.0])]
    rows += [(7, 1, [0.5, 1.0]), (8, 1, [0.5, 1.0]), (9, 2, [0.25, 0.5]), (10, 2, [0.25, 0.5]), (11, 3, [0.25, 0.5]), (-100, 1, [-1.0, -2.0]), (12, -5, [0.4, 0.4])]
    want = [x for x in negatives([(i, k, v if v is None else [*v, *[0.0] * (2 - len(v))]) for i, k, v in rows])]
    assert mined(spark, rows) == want and want
    assert mined(spark, []) == [] and mined(spark, rows[5:10]) == []
    big = [(100 * i, i % 2, [1.0e6 * (i + 1), 0.3e6 * i]) for i in range(8)]  # sums beyond 2 ** 53
    assert mined(spark, big, "double") == negatives(big)
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, label int, embedding array<float>, score int, n double").toDF("vec_id",
        "label", "embedding", "LABEL", "n")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df).collect()), key=str) == want


def test_intervals_hold():
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=(40, 5)), rng.normal(size=(50, 5)) + 2
    (ca, ra), (cc, rc) = hard_negatives.ball(a), hard_negatives.ball(c)
    low, most = hard_negatives.intervals(ca[None], np.array([ra]), cc[None], np.array([rc]))
    assert low[0, 0] <= (a @ c.T).min() and (a @ c.T).max() <= most[0, 0]


def test_pairs_of_nodes_are_dropped():
    """Of far clusters whole groups of anchors are ruled out before a score is made."""
    rng = np.random.default_rng(2)
    near, far = (np.round(rng.normal(size=(256, 8)) + shift) for shift in (50, -50))
    row = lambda m, at: {"n": len(m), "width": 8, "wide": False, "vectors": m.astype("<i2").tobytes(), "labels": [1] * len(m), "keys": list(range(at,
        at + len(m))), "ids": list(range(at, at + len(m)))}
    s = hard_negatives.Search(row(near, 0), np.zeros((256, 1), np.int64), np.full((256, 1), 2**62), 3, True)
    alive, _ = s._descend(hard_negatives.BlockTree(far))
    assert not alive.any()
    s.meet(row(near, 1000))
    assert len(s.rows()[0]) == 3 * 256


# 12


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 12), min_size=1), st.sampled_from([32, 40]))
def test_shortest_first_is_one_by_one(counts, capacity):
    placed, rooms, n = shortest_pack.shortest_first(counts, capacity)
    packs = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            best = max(packs, key=lambda p: capacity - sum(p), default=None)
            if best is None or capacity - sum(best) < length:
                packs.append(best := [])
            best.append(length)
    assert n == len(packs) and sorted(capacity - sum(p) for p in packs) == sorted(r for r, _, k in rooms for _ in range(k))
    got = defaultdict(list)
    for length in counts:
        runs = sorted(r for r in placed if r[0] == length)
        for run, after in zip(runs, [*runs[1:], (0, counts[length])]):
            for i in range(after[1] - run[1]):
                got[run[2] + i // run[3]].append((run[4] + i % run[3] * length, length))
    assert sum(map(len, got.values())) == sum(counts.values())
    for parts in got.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at <= capacity


def sequences_of(rows, capacity):
    """The tokens of each sequence; its pieces follow one another without a gap."""
    parts = defaultdict(list)
    for r in rows:
        parts[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for some in parts.values():
        at = 0
        for o, n in sorted(some):
            assert o == at and n > 0
            at += n
        assert at <= capacity
        sizes.append(at)
    return sizes


def padding(sizes, capacity):
    return sum(capacity - n for n in sizes if n & (n - 1))


def lib():
    from tokenizers import Tokenizer

    from brindle.llm.common import tokenizer_path

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("capacity", [4096, 128])
def test_shortest_pack(spark, data, capacity):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    library = lib()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    rows, at = shortest_pack.pack(docs.repartition(3), capacity=capacity).collect(), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        at[r.doc_id].append((r.start, r.length))
    for i, parts in at.items():
        assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(ids[i])
    assert set(at) == set(ids)
    sizes = sequences_of(rows, capacity)
    assert padding(sizes, capacity) <= 0.001 * sum(sizes)
    whole = sum(len(p) == -(-len(ids[i]) // capacity) for i, p in at.items())
    assert whole >= 0.8 * len(ids)


def test_shortest_pack_of_odd_rows(spark):
    rows = [(None, None)] * 90 + [(1, ""), (1, ""), (2, "Some words. " * 9000), (3, " "), (4, "x")] + [(5, "the same words")] * 50
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").selectExpr(f"cast(doc_id as {kind}) doc_id",
            "text", "length LENGTH", "1 offset")
        for one_in in (1, 3, 1000):
            got = shortest_pack.pack(df, cut_one_in=one_in, capacity=64)
            assert got.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
            got = got.collect()
            assert sum(r.length for r in got) == 90 + 2 + 27001 + 1 + 2 + 50 * 4
            sizes = sequences_of(got, 64)
            assert one_in != 1 or padding(sizes, 64) == 0
    assert shortest_pack.pack(df.limit(0)).count() == 0


# 13


def compared(rows, least, ranks):
    """The contract in plain Python."""
    docs = [(t or "", g or "", s or "") for t, g, s in rows]
    found = [[w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)}))] for t, _, _ in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        df, n = Counter(), defaultdict(Counter)
        for (_, g, s), words in zip(docs, found):
            if g == lang:
                df.update(set(words))
                n[s].update(words)
        kept = [w for w in df if df[w] >= least]
        every = sum(n.values(), Counter())

        def p(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        q, ps = p(every), {s: p(c) for s, c in n.items()}
        for s in n:
            pairs = sorted(((sum(abs(ps[s][w] - ps[o][w]) for w in kept), o) for o in n if o != s), key=lambda x: (-x[0], x[1].encode()))
            own = sorted(((ps[s][w] - q[w], w) for w in kept if n[s][w] and ps[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:ranks]
            out += [(lang, s, part, item, v, i + 1) for part, items in (("pair", pairs), ("term", own)) for i, (v, item) in enumerate(items)]
    return sorted(out)


def test_divergence_equals_sql(spark, data):
    assert spark_rows(divergence.query(spark, data)) == duck_rows(divergence.SQL, data)


@pytest.mark.parametrize("small", [True, False])
def test_divergence_is_brute_force(spark, monkeypatch, small):
    rng = random.Random(5)
    words = ["Ab", "ab", "É", "é", "中文", "x" * 300, "q r", "it's", "a1b", "_z_"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) if rng.random() < 0.9 else None, rng.choice(["en", "en", None, "",
        "d\0e"]), rng.choice(["s1", "s2", "s3", None, "", "é", "Z"])) for _ in range(300)]
    rows += [("the same text of many rows", "en", "s1")] * 200 + [("rare", "alone", "s1"), (None, "alone", "s2")]
    if small:
        for name, value in (("TILE", 2), ("CHUNK", 3), ("HELD", 20)):
            monkeypatch.setattr(divergence, name, value)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, place int, p0 int").toDF("text", "lang",
            "source", "TERM", "p0").repartition(3)
        assert sorted(map(tuple, divergence.divergence(df, 4, 5).collect())) == compared(rows, 4, 5)
        assert divergence.divergence(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
