import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators.dedupe import first_of_each
from brindle.sources import tables
from brindle.streaming import stateful as S


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.integers(1, 5), st.integers(1, 60))
def test_limiter_holds(times, limit, window):
    times = sorted(times)
    ok, _ = S.admit(times, [], limit, window)
    admitted = [t for t, a in zip(times, ok) if a]
    for i, t in enumerate(times):
        before = [x for x, a in zip(times[:i], ok) if a and t - x <= window]
        assert ok[i] == (len(before) < limit)
    assert len(admitted) <= len(times)


def test_edges():
    assert S.admit([0, 60, 61], [], 1, 60)[0] == [True, False, True]
    assert S.hits([0, 10, 3600, 3601], None, 3600)[0] == [False, True, False, True]
    assert S.fires([0, 1, 2, 3, 4], None, 2)[0] == [True, False, True, False, True]


def events(spark, n=200):
    rng = random.Random(2)
    return spark.createDataFrame([(f"k{rng.randrange(4)}", i, 1000 + i // 3) for i in range(n)], "key string, event_id long, at long")


def streamed(spark, tmp_path, df, start, name):
    """The rows that a stream of three files makes."""
    src = str(tmp_path / "src")
    for i in range(3):
        df.where(F.floor(F.col("event_id") / 70) == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def decided(spark, tmp_path, df, start, flag):
    got = streamed(spark, tmp_path, df.withColumn("at", F.timestamp_seconds("at")), start, f"decided_{flag}_{tmp_path.name}")
    return sorted((r.event_id, r[flag]) for r in got.collect())


def test_keyed_streams_equal_batch(spark, tmp_path):
    df = events(spark)
    for name, batch, stream, flag in (("l", S.limit_batch(df, 3, 10), lambda s: S.limit_stream(s, 3, 10), "admitted"), ("c", S.cache_batch(df, 7),
        lambda s: S.cache_stream(s, 7), "hit"), ("d", S.debounce_batch(df, 5), lambda s: S.debounce_stream(s, 5), "fired")):
        assert decided(spark, tmp_path / name, df, stream, flag) == sorted((r.event_id, r[flag]) for r in batch.collect())


def test_state_falls_with_the_watermark(spark, tmp_path):
    """Keys whose events are long past hold nothing; one that comes back is as new, which is what its old state would say."""
    df = spark.createDataFrame([(f"k{i % 50}" if i < 140 else "late" if i < 205 else "k3", i, 1000 + i // 70 * 1000 + i % 7) for i in range(210)],
        "key string, event_id long, at long")
    kept = []

    def start(stream):
        return S.limit_stream(stream, 3, 10, "1 second")

    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    timed = df.withColumn("at", F.timestamp_seconds("at"))
    for i in range(3):
        timed.where(F.floor(F.col("event_id") / 70) == i).coalesce(1).write.mode("append").parquet(src)
        q = start(spark.readStream.schema(timed.schema).parquet(src)).writeStream.outputMode("append").format("parquet").option("checkpointLocation",
            cp).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None
        kept.append(q.recentProgress[-1].stateOperators[0].numRowsTotal)
    got = sorted((r.event_id, r.admitted) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.event_id, r.admitted) for r in S.limit_batch(df, 3, 10).collect())
    assert kept[0] >= 50 and kept[2] < 10


def test_windows_and_dedupe(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("day", F.to_date("ts"))
    got = streamed(spark, tmp_path / "w", e, lambda s: S.windowed_counts(s, "ts", "event_type", "1 day", "1 hour"), "windows")
    closed = {(r.start, r.event_type): r.n for r in got.collect()}
    batch = {(r.start, r.event_type): r.n for r in e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"),
        "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n").collect()}
    assert closed and all(batch[k] == n for k, n in closed.items())
    twice = e.union(e)
    got = streamed(spark, tmp_path / "d", twice, lambda s: S.dedupe_stream(s, "event_id", "ts", "40 days"), "once")
    assert got.count() == 210  # the ids that the three files hold


def test_incremental_kb(spark, tmp_path):
    path = str(tmp_path / "kb")
    add = S.add_to_kb(path)
    first = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    add(first, 0)
    second = spark.createDataFrame([(4, "c"), (5, "d")], "doc_id long, text string")
    add(second, 1)
    add(second, 1)  # the batch again, after a failure
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [1, 3, 5]


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"query": "q", "model": "m", "reranked": [{"idx": 3, "text": "a", "reranker_score": 0.9}, {"idx": 1, "text": "b"}]}')
    assert [(r.pos, r.idx) for r in tables.reranked(spark, str(tmp_path / "r.json"), 1).collect()] == [(0, 3)]
    (tmp_path / "kb.jsonl").write_text('{"doc_id": "x", "text": "t"}\n\n{"doc_id": "y", "text": "u"}\n')
    kb = tables.json_lines(spark, str(tmp_path / "kb.jsonl"), tables.KB)
    assert [r.doc_id for r in kb.collect()] == ["x", "y"]
    faq = spark.createDataFrame([('{"faqs": [{"q": "Q1", "a": "A1"}]}',)], "json string")
    assert tables.faq_texts(faq).first().text == "Q: Q1 A: A1"
    (tmp_path / "p_v1.yaml").write_text("version: v1\nprompts:\n  - {name: a, template: 'hi {{ x }}'}\n")
    rows = tables.yaml_files(spark, str(tmp_path / "p_v*.yaml"), "version string, name string, template string", lambda d: [(d["version"], p["name"],
        p["template"]) for p in d["prompts"]])
    assert [tuple(r) for r in rows.collect()] == [("v1", "a", "hi {{ x }}")]
    files = tables.file_versions(spark, str(tmp_path / "r.json")).first()
    assert len(files.sha256) == 64 and len(files.md5) == 32
    binary = spark.createDataFrame([("f", bytearray(b"one|two"))], "path string, content binary")
    assert [r.text for r in tables.pages_by(binary, lambda b: (x.decode() for x in b.split(b"|"))).collect()] == ["one", "two"]
    v = spark.createDataFrame([(1, "c", [1.0])], "id long, chunk string, vector array<float>")
    tables.write_index(v, str(tmp_path / "ix"), "s", "m", "2024")
    assert tables.read_index(spark, str(tmp_path / "ix")).first().chunk == "c"
    up = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, ver int")
    assert sorted(tuple(r) for r in tables.latest(up, ["k"], "ver").collect()) == [("a", 2), ("b", 1)]
    assert first_of_each(up, F.col("k"), "ver").count() == 2


def test_a_call_decides_all_keys_of_a_group():
    """One call and one timer for a group's keys; each falls at its own time, a null key is one like others."""
    state, timers = {}, set()

    class Kept:
        iterator, updateValue, removeKey = staticmethod(lambda: iter(list(state.items()))), staticmethod(state.__setitem__), staticmethod(state.pop)

    class Handle:
        getMapState = staticmethod(lambda *a: Kept)
        listTimers, registerTimer, deleteTimer = staticmethod(lambda: list(timers)), staticmethod(timers.add), staticmethod(timers.discard)

    class Time:
        getCurrentWatermarkInMs = getExpiryTimeInMs = staticmethod(lambda: 12_001)

    one = S._Decider(S._of_one(S.hits, 10_000_000), "hit", 10_000_000)
    one.init(Handle)
    rows = [("a", 1, 0), ("b", 2, 2), ("a", 3, 9), (None, 5, 3), ("b", 4, 2), (None, 6, 14)]
    made = [r for df in one.handleInputRows((7,), iter([pd.DataFrame({"key": [k], "event_id": [i], "at": [pd.Timestamp(t, unit="s")]}) for k, i, t in rows]), None) for r in df.itertuples(index=False)]
    assert {(r.key, r.event_id, r.hit) for r in made} == {("a", 1, False), ("a", 3, True), ("b", 2, False), ("b", 4, True), (None, 5, False), (None, 6, False)}
    assert state == {("ka",): ([0],), ("kb",): ([2_000_000],), ("",): ([14_000_000],)} and timers == {10_001}
    list(one.handleExpiredTimer((7,), Time, Time))
    assert state == {("",): ([14_000_000],)} and timers == {24_001}
