"""Streams that write back, file changes, gated runs and exports."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.vectors import hash_embeddings
from brindle.operators import dedupe
from brindle.plans import stream_queries
from brindle.sources import changes
from brindle.streaming import gated, stateful, write_back


def one_by_one(rows, ttl, threshold):
    """The three tiers, request after request."""
    exact, near, out = {}, [], {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        v = np.array(r["v"], dtype=np.float64)
        n = np.sqrt((v * v).sum())
        unit = v / n if n else v
        scores = [float(u @ unit) for u, _ in near]
        if r["question"] in exact and r["at"] - exact[r["question"]][0] < ttl:
            out[r["id"]] = ("prompt_cache", exact[r["question"]][1])
        elif scores and max(scores) >= threshold:
            out[r["id"]] = ("semantic_cache", near[int(np.argmax(scores))][1])
        else:
            answer = "A:" + r["question"]
            exact[r["question"]] = (r["at"], answer)
            near.append((unit, answer))
            out[r["id"]] = ("llm", answer)
    return out


def requests(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice([-1.0, 0.0, 1.0]) for _ in range(6)] for _ in range(25)]
    base[0] = [0.0] * 6  # no direction: only the exact tier can hit
    rows = []
    for i in range(n):
        k = rng.randrange(25)
        near = rng.random() < 0.4 and k
        rows.append({"id": 1000 + i, "seq": i, "at": i * 20, "question": f"q{k}" + "x" * bool(near), "v": [x + (0.05 * (j == 0)) * bool(near) for j, x in enumerate(base[k])]})
    return rows


SCHEMA = "id long, seq long, at long, question string, v array<float>"


def model(q):
    return F.concat(F.lit("A:"), q)


@pytest.mark.parametrize("at_once", [4, 512])
def test_write_back_is_one_by_one(spark, tmp_path, at_once):
    rows = requests(160, 7)
    want = one_by_one(rows, 600, 0.92)
    assert {s for s, _ in want.values()} == {"prompt_cache", "semantic_cache", "llm"}
    path = str(tmp_path / "cascade")
    serve = write_back.serve(path, model, 600, 0.92, at_once)
    for version, cut in enumerate(((0, 70), (70, 71), (71, 160))):
        batch = spark.createDataFrame([tuple(r.values()) for r in rows[slice(*cut)]], SCHEMA).repartition(3)
        serve(batch, version)
        if version == 2:
            entries = write_back.stored(spark, f"{path}/entries").count()
            serve(batch, version)  # the batch again, after a failure
            assert write_back.stored(spark, f"{path}/entries").count() == entries == sum(s == "llm" for s, _ in want.values())
    got = {r.id: (r.source, r.answer) for r in spark.read.parquet(f"{path}/answers").collect()}
    assert got == want
    serve(spark.createDataFrame([], SCHEMA), 3)
    assert spark.read.parquet(f"{path}/answers").count() == 160


def test_write_back_over_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(hash_embeddings(docs), "doc_id").collect()
    want = one_by_one([{"id": r.doc_id, "seq": r.doc_id, "at": r.doc_id * 60, "question": r.text, "v": np.array(r.embedding, dtype=np.float32)} for r in rows], 3600, 0.92)
    got = {r.id: r.source for r in stream_queries.cache_write_back(spark, data).collect()}
    assert got == {i: s for i, (s, _) in want.items()} and len(set(got.values())) > 1


def look(spark, tmp_path, interval="0"):
    changes.register(spark)
    before = {tuple(r) for r in read_log(spark, tmp_path)}
    q = spark.readStream.format("file_changes").option("intervalSeconds",
        interval).load(str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation",
        str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(60)
    assert q.exception() is None
    return sorted((os.path.basename(p), n) for p, _, n in {tuple(r) for r in read_log(spark, tmp_path)} - before)


def read_log(spark, tmp_path):
    return spark.read.schema(changes.SCHEMA).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []


def test_file_changes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_text(name)
    (folder / ".hidden").write_text("x")
    assert look(spark, tmp_path) == [("a", 1), ("b", 1), ("c", 1)]
    assert look(spark, tmp_path) == []  # a restart: nothing has changed
    time.sleep(0.01)
    (folder / "b").write_text("bb")
    (folder / "d").write_text("ddd")
    assert look(spark, tmp_path, "3600") == []  # too soon
    assert look(spark, tmp_path) == [("b", 2), ("d", 3)]


def test_cursor_of_equal_times():
    files = [("a", 5, 1), ("b", 5, 1), ("c", 6, 1)]
    cursor = changes.moved({"modified_us": -1, "seen": [], "looked": 0}, files[:1], 1.0)
    assert changes.changed(files, cursor) == files[1:]
    cursor = changes.moved(cursor, files[1:2], 2.0)
    assert cursor["seen"] == ["a", "b"] and changes.changed(files, cursor) == files[2:]
    assert changes.moved(cursor, [], 3.0) == {**cursor, "looked": 3.0}


def test_gated_runs(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, t string")
    made = []
    index = gated.GatedIndex(spark, str(tmp_path / "g"), lambda r: made.append(1) or r)
    assert index.index() is None
    add = gated.Ledger.add

    def killed(self, *values):
        raise KeyboardInterrupt

    monkeypatch.setattr(gated.Ledger, "add", killed)  # between the index and its hash
    with pytest.raises(KeyboardInterrupt):
        index.run(rows)
    monkeypatch.setattr(gated.Ledger, "add", add)
    assert index.index() is None and index.run(rows) == "built" and len(made) == 2
    assert index.run(rows.repartition(3)) == "skipped" and index.index().count() == 3
    assert index.run(rows.limit(2)) == "built" and index.run(rows, force=True) == "built" and index.index().count() == 3
    assert gated.fingerprint(rows) != gated.fingerprint(rows.withColumnRenamed("t", "u")) and gated.fingerprint(rows.limit(0)) == gated.fingerprint(rows.limit(0))


def test_watched_files_run_the_gate(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = tmp_path / "in" / "manual.txt"
    read = lambda: spark.read.text(str(tmp_path / "in"))
    runs = []
    index = gated.GatedIndex(spark, str(tmp_path / "g"), lambda r: runs.append(1) or r)
    for text in ("one", None, "two", "two"):
        if text:
            time.sleep(0.01)
            source.write_text(text)
        q = gated.watch(index, str(tmp_path / "in"), read, str(tmp_path / "cp"), 0)
        q.awaitTermination(60)
        assert q.exception() is None
    assert len(runs) == 2 and index.index().first().value == "two"  # written again with the same text: the gate holds


def test_exports(spark, tmp_path, monkeypatch):
    rows = spark.range(20).withColumnRenamed("id", "doc_id")
    exports = gated.Exports(spark, str(tmp_path / "e"), "doc_id")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    add = gated.Ledger.add
    monkeypatch.setattr(gated.Ledger, "add", lambda self, *v: 1 / 0)  # between the export and the cursor
    with pytest.raises(ZeroDivisionError):
        exports.export(rows.where("doc_id < 5"))
    monkeypatch.setattr(gated.Ledger, "add", add)
    assert ids(exports.export(rows.where("doc_id < 10"))) == list(range(10))
    assert ids(exports.export(rows, since=3)) == [17, 18, 19] and ids(exports.export(rows, force_all=True)) == list(range(20))
    assert ids(exports.export(rows)) == list(range(10, 20)) and ids(exports.export(rows)) == []


def test_increments_read_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "kb")
    add = stateful.add_to_kb(path, 64)
    docs = spark.range(300).selectExpr("id as doc_id", "concat('text  ', id % 100) as text")
    add(docs.where("doc_id < 150"), 0)
    add(docs.where("doc_id >= 150"), 1)
    kb = spark.read.parquet(path)
    assert sorted(r.doc_id for r in kb.collect()) == list(range(100)) and kb.where("kb_version = 1").count() == 0
    hashes = dedupe.new_texts(docs, docs.limit(0)).count()
    assert hashes == kb.select("text_hash").distinct().count() == 100


def test_late_requests_are_dropped_and_quantiles_hold(spark, data):
    r = stream_queries._requests(spark, data)
    hours = stateful.request_metrics(r, "1 hour", None)
    assert hours.agg(F.sum("requests")).first()[0] == r.count()
    got = stateful.latency_quantiles(hours, ["route"], [0.5, 0.95]).collect()
    for row in got:
        values = sorted(x.latency for x in r.where(F.col("route") == row.route).collect())
        for q, v in ((0.5, row.p50), (0.95, row.p95)):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.03


def test_vector_store(spark, tmp_path):
    from brindle.sources.vector_store import VectorStore

    store = VectorStore(spark, str(tmp_path / "v"), 4)
    rows = lambda *items: spark.createDataFrame(list(items), "id long, vector array<float>, metadata map<string,string>")
    assert store.rows().count() == 0
    store.compact()
    store.upsert(rows((1, [1.0, 0.0], {"a": "1"}), (2, [0.0, 1.0], None), (2, [0.0, 1.0], None)), 1)
    store.upsert(rows((2, [1.0, 1.0], {"a": "2"}), (3, [0.0, 2.0], {"a": "3"})), 2)
    store.upsert(rows((2, [1.0, 1.0], {"a": "2"}), (3, [0.0, 2.0], {"a": "3"})), 2)
    store.delete(spark.createDataFrame([(1,), (9,)], "id long"), 3)
    want = [(2, [1.0, 1.0], {"a": "2"}), (3, [0.0, 2.0], {"a": "3"})]
    seen = lambda: sorted((r.id, r.vector, r.metadata) for r in store.rows().collect())
    assert seen() == want and store.versions().count() == 6
    store.compact()
    assert seen() == want and store.versions().count() == 2
    store.upsert(rows((1, [2.0, 2.0], {"a": "4"})), 4)
    assert [r.id for r in store.rows([1, 7]).collect()] == [1] and store.rows().count() == 3
    q = spark.createDataFrame([(0, [0.0, 1.0])], "qid long, vector array<float>")
    near = store.nearest(q, 2, where=F.col("metadata")["a"] != "4").orderBy("rank").collect()
    assert [(r.vec_id, r.metadata["a"]) for r in near] == [(3, "3"), (2, "2")]


def test_chain_feeds_answers_on(spark):
    from brindle.operators import context

    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    out = context.chain(rows, [("one", "<{{ t }}>", {"t": "text"}), ("two", "{{ a }}{{ b }}{{ none }}!", {"a": "one", "b": "id"})], lambda name, p: F.concat(F.lit(name + ":"), p))
    assert [(r.one, r.two) for r in out.orderBy("id").collect()] == [("one:<abc>", "two:one:<abc>1!"), ("one:<>", "two:one:<>2!")]


def test_request_log(spark):
    from brindle.operators import metrics

    r = metrics.request_log(spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:01.234567' b"), "a", "b", F.lit(0.00012345678)).first()
    assert (r.latency_s, r.cost_usd) == (1.235, 0.000123)
