"""The queries on whole small tables against brute force, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, grammar, licences, mixing, near_copies, packing, quality, registry, simhash, token_counts, warc, winnowing

from ..compare import duck_rows, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Grande palabra única, and more of it. " * 4000
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, LONG, "b"), (5, "twice the very same row here", "a"), (5, "twice the very same row here", "a"),
    (None, "a row without an id, but with words", "b"), (6, "equal texts of two documents, long enough to be kept as they are here", "a"), (7,
        "equal texts of two documents, long enough to be kept as they are here", None), (8, "x", "a"),
]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, and other columns with names that operators use."""
    df = spark.createDataFrame([(i, t, s, 1, 2, "x", 3.0) for i, t, s in ROWS], "doc_id long, text string, source string, size int, block int, fp string, rank double")
    return df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).toDF("doc_id", "text", "source", "TEXT", "block",
        "fp", "rank", "lang", "n_chars")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


OPERATORS = {
    "mixing": mixing.mixed_words, "licences": licences.licences, "quality": quality.quality, "winnowing": winnowing.fingerprints,
        "packing": packing.pack, "simhash": simhash.near_duplicates, "tokens": token_counts.token_counts,
    "mixed": mixing.mixed_documents, "good": quality.keep_good, "first": simhash.keep_first,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(name, odd, empty):
    rows = OPERATORS[name](odd).collect()
    if name in ("mixed", "good", "first"):
        assert rows and list(rows[0].asDict()) and OPERATORS[name](odd).columns == odd.columns
    elif name != "packing":
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, *_ in ROWS)
    assert OPERATORS[name](empty).count() == 0


def test_odd_values(spark, odd, tmp_path):
    q = {(r.doc_id, r.n_words): r for r in quality.quality(odd).collect()}
    assert q[1, 0].base_failed and not q[1, 0].kept and q[3, 0].n_dup_lines == 0
    s = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert {s[i].component_id for i in (1, 2, 3)} == {1} and s[1].fingerprint == "0" * 16 and s[7].component_id == 6
    assert sorted(r.doc_id or 0 for r in simhash.keep_first(odd).collect()) == [0, 1, 4, 5, 6, 8]
    t = {r.doc_id: r for r in token_counts.token_counts(odd).collect()}
    assert (t[1].n_bytes, t[1].n_tokens, t[4].over_limit) == (0, 0, True)
    p = packing.pack(odd).collect()
    assert sum(r.doc_id == 5 for r in p) == 2 and max(r.piece for r in p if r.doc_id == 4) > 5 and max(r.length for r in p) == 2048
    grammar.write_tokens(odd, str(tmp_path / "t"))
    got = sorted(grammar.stored_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8] and got[1].n_tokens == 1
    m = mixing.mixed_words(odd).collect()
    assert all(r.taken <= 3 * r["size"] for r in m) and sum(r["size"] for r in m if r.doc_id == 5) == 12


def test_first_rows_without_ids(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(words[n * 40 : n * 40 + 40])
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, None), (3, text(2)), (3, text(3)), (3, text(3)), (2, text(4)), (9, text(4)), (9, text(5)), (None, text(4))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, k1 int").repartition(3)
    got = simhash.keep_first(df)
    want = [(None, text(0)), (None, text(1)), (None, None), (3, text(2)), (3, text(3)), (2, text(4)), (9, text(5))]
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_near_dedup_of_edited_copies(spark, docs, texts, monkeypatch):
    """The pipeline's stage against all pairs, with copies that differ in a few words or in one passage."""
    import corpus_pipeline as P

    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (None, "no id"), (None, "no id"), (7, "of one id"), (7, "of one id"), (7, "and another text")]
    for i, t in texts.items():
        w = t.split()
        if len(w) > 60:
            for n in (1, len(w) // 100, len(w) // 50):
                new = list(w)
                for at in rng.integers(0, len(w), n):
                    new[at] = f"edit{rng.integers(1000)}"
                rows.append((10_000 + len(rows), " ".join(new)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [near_copies.shingles(t or "").tolist() for _, t in rows]
    sets, like, root = [set(s) for s in sets], 0, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            both = len(sets[i] & sets[j])
            either = len(sets[i]) + len(sets[j]) - both
            if not either or both / either >= 0.8:
                like += sets[i] != sets[j]
                root[find(j)] = find(i)
    groups = defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(i)
    want = sorted(str(rows[min(g, key=order.index)][0]) for g in groups.values())
    for together, sent in ((8192, 10_000), (4, 0)):
        monkeypatch.setattr(near_copies, "TOGETHER", together)
        monkeypatch.setattr(near_copies, "SENT_KEYS", sent)
        got = P.near_dedup(spark, df, "").collect()
        assert like > 100 and sorted(str(r.doc_id) for r in got) == want


def varied(rng, base, edits):
    return " ".join([f"new{rng.integers(10**6)}" if i in edits else w for i, w in enumerate(base)])


def groups_of_all_pairs(sets, least):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if near_copies.similarity(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_a_band_loses_no_link():
    """A thousand varied copies in one band: the same groups as all pairs, with few comparisons."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(220)]
    texts = [varied(rng, base, set(rng.choice(220, rng.integers(0, 14), replace=False).tolist())) for _ in range(1000)]
    sets = [near_copies.shingles(t) for t in texts]
    near, links = near_copies.Neighbours(0.8), []
    for i, s in enumerate(sets):
        links += [(a, i) for a in near.add(i, s)]
    want, got = groups_of_all_pairs(sets, 0.8), [near.root(i) for i in range(1000)]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) == 1000 - len(links) and len(set(want)) > 20
    assert all(near_copies.similarity(sets[a], sets[b]) >= 0.8 for a, b in links)


def test_chains_behind_many_copies(spark, monkeypatch):
    """Seventy copies of a text, one that is like them, and one that is like that one alone: one row of each group stays."""
    import corpus_pipeline as P

    rng, rows = np.random.default_rng(9), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(300)]
        rows += [varied(rng, base, {int(rng.integers(0, 5))}) for _ in range(70)]
        b = varied(rng, base, {20, 60, 100, 140}).split()
        rows += [" ".join(b), varied(rng, b, {160, 180, 200, 220, 240, 260})]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    for together in (8192, 40):
        monkeypatch.setattr(near_copies, "TOGETHER", together)
        assert sorted(r.doc_id for r in P.near_dedup(spark, df, "").collect()) == [72 * g for g in range(12)]


def test_mixing(docs, texts):
    rows = mixing.mixed_words(docs).collect()
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id])) and r.taken <= 3 * r["size"]
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items()) and abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1e-3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed_words(docs.repartition(3)).collect()))
    mixed = Counter()
    for r in mixing.mixed_documents(docs).collect():
        own, words = WORD.findall(texts[r.doc_id]), WORD.findall(r.text)
        mixed[r.doc_id] += len(words)
        assert not Counter(words) - Counter(own) and r.n_chars == len(r.text)
    assert mixed == Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_mixed_documents_of_equal_rows(spark):
    """Equal rows are documents of their own: each word of them is taken as often as their words in all."""
    rows = [(1, "one two three four", "a")] * 300 + [(None, "five six", None)] * 300 + [(2, "x y z " * 50, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = defaultdict(int)
    for r in mixing.mixed_words(df, block=4).collect():
        want[r.doc_id] += r.taken
    got = defaultdict(int)
    for r in mixing.mixed_documents(df, block=4).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == want and want[1] > 1200


def test_mixing_of_many_sources(spark, docs, monkeypatch):
    """A plan that stays a table reaches the same targets as one that is sent, in every source."""
    many = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 > 0, F.concat(F.lit("é"),
        (F.col("doc_id") % 29).cast("string")))).withColumn("text", F.when(F.col("doc_id") % 29 != 5, F.col("text")))
    sent = {r.doc_id: r for r in mixing.mixed_words(many).collect()}
    monkeypatch.setattr(mixing, "SENT_SOURCES", 2)
    monkeypatch.setattr(mixing, "RANGE_SLOTS", 7)
    rows, taken, goal = mixing.mixed_words(many).collect(), defaultdict(int), {}
    names = {r.doc_id: r.source for r in many.collect()}
    assert len(rows) == len(sent) == len(names)
    for r in rows:
        other = sent[r.doc_id]
        assert (r["size"], r.source_size) == (other["size"], other.source_size) and abs(r.target - other.target) < 1e-6 and r.taken <= 3 * r["size"]
        taken[names[r.doc_id]] += r.taken
        goal[names[r.doc_id]] = r.target
    assert len(goal) > 20 and all(abs(taken[s] - t) <= 0.5 for s, t in goal.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed_words(many.repartition(3)).collect()))
    _, mix = mixing.mixture(mixing.sized(many))
    places = [(r.shard, r.slot) for r in mix.collect()]
    assert len(set(places)) == len(places) and max(places)[0] == (len(places) - 1) // mixing.SHARD_BLOCKS


def test_quality(docs, texts, spark, data):
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    good = [r for r in labels if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [r for r in labels if r.quality == 0]
    assert all(rows[r.doc_id].kept for r in good) and sum(rows[r.doc_id].kept for r in bad) <= 0.2 * len(bad)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(i for i, r in rows.items() if r.kept)


def test_licences(docs, texts):
    machine = licences.automaton()
    got = {r.doc_id: tuple(r)[1:] for r in licences.licences(docs).collect()}
    assert got == {i: licences.scan(t, machine) for i, t in texts.items()} and sum(v[1] for v in got.values())


def test_tokens(docs, texts):
    from tokenizers import Tokenizer

    from brindle.llm.common import tokenizer_path

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect()} == {i: (len(texts[i].encode()), len(v)) for i, v in ids.items()}
    spaced = docs.withColumn("text", F.regexp_replace(F.regexp_replace("text", "\n", "\n\n  "), r"\. ", ".  \t"))
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) for r in spaced.collect()}
    counted = token_counts.token_counts(spaced)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == want and "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_token_files(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    from brindle.llm.common import tokenizer_path

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    path = str(tmp_path / "tokens")
    grammar.write_tokens(docs.repartition(3), path, shard_tokens=20_000)
    at, want = 0, []
    for i in sorted(texts):
        ids = lib.encode(texts[i], add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, grammar.stored_tokens(spark, path).collect())) == want
    assert spark.read.parquet(path).count() > 3
    one = spark.read.parquet(path).orderBy("part", "seq").first().asDict()
    ids = grammar._shard(one).decode()
    assert (grammar.tokens_at(one, 1234, 99) == ids[1234:1333]).all()


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    from brindle.llm.common import tokenizer_path

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    rows, seqs = packing.pack(docs, keep_ids=True).collect(), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.start == 2048 * r.piece and r.ids == part and r.ids_crc32 == zlib.crc32(part)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= 1.01 * sum(map(len, ids.values())) / 2048 + 1
    assert packing.sequences(packing.pack(docs, keep_ids=True)).where(F.length("ids") == 4 * F.col("n_tokens")).count() == len(seqs)


def test_winnowing(docs, texts):
    order = sorted(texts)
    for r in winnowing.fingerprints(docs.repartition(5)).collect():
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        n = len(text) // 2
        new = text[: len(text) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), winnowing.printed(winnowing.winnow(text)))
        assert r.edited_fingerprint == winnowing.printed(winnowing.winnow(new)) and abs(r.near_edited - winnowing.likeness(winnowing.winnow(text), winnowing.winnow(new))) < 1e-12
        assert abs(r.near_next - winnowing.likeness(winnowing.winnow(text), winnowing.winnow(after))) < 1e-12


def components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(docs, texts):
    fps = dict(zip(texts, (int(x) for x in simhash.fingerprints_of(list(texts.values())))))
    want = components(fps)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()} == {i: (fps[i], want[i]) for i in fps}


def test_crowded_anchors(spark):
    rng = np.random.default_rng(2)
    fps = {i: 0 if i % 3 == 0 else int(rng.integers(0, 2**63)) for i in range(120)}
    for i in range(120, 400):  # a crowd around zero, and chains
        fps[i] = fps[int(rng.integers(0, i))] ^ (1 << int(rng.integers(0, 64)))
    want = components(fps)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in set(fps.values())]
    roots = {r.node: r.root for r in simhash.connected(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    got = {i: roots.get(int(np.uint64(v).astype(np.int64)), int(np.uint64(v).astype(np.int64))) for i, v in fps.items()}
    assert len(set(zip(got.values(), want.values()))) == len(set(got.values())) == len(set(want.values()))


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 0.00001)
    assert simhash.components(spark.createDataFrame([(i, "the very same words") for i in range(5)], "doc_id long, text string")).select("component_id").distinct().count() == 1


def test_points_belong_to_their_anchors():
    fps = np.random.default_rng(8).integers(0, 2**63, 300, dtype=np.int64)
    rows, anchors, flips = simhash.meetings(fps)
    seen = np.zeros(len(fps), dtype=np.uint64)
    for r, a, f in zip(rows, anchors, flips):
        assert not seen[r] & f
        seen[r] |= f
        for i in range(64):
            if int(f) >> i & 1:
                point = np.array([fps[r]]).view(np.uint64) ^ np.uint64(1 << i)
                assert simhash.anchors_of(point.view(np.int64))[1][0] == a
    assert (seen == np.uint64(2**64 - 1)).all()


def test_components_of_a_chain(spark):
    from brindle.llm.graph import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert connected(edges.limit(0)).count() == 0


def test_chat(spark, data):
    rows = chat.repaired(spark.read.parquet(f"{data}/conversations.parquet")).collect()
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append(r)
    for turns in convs.values():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        roles = re.findall(r"<\|im_start\|>(\w+)\n", "".join(r.rendered for r in turns))
        assert roles[-1] == "assistant" and all(chat.ROLES.index(b) + 1 in chat.NEXT[chat.ROLES.index(a) + 1] for a, b in zip(roles, roles[1:]))


def test_chat_across_partitions(spark):
    rng = np.random.default_rng(1)
    names = ["user", "assistant", "system", "tool", None, "Human"]
    rows = [(7, i, names[rng.integers(0, 6)], f"t{i}") for i in range(2000)] + [(8, 0, "user", "x"), (6, 0, "assistant", None), (None, None, None, None), (8, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(3)
    got = chat.repaired(df).collect()
    long = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.position)
    cost = sum(chat.RELABEL * ("relabel" in r.action) + chat.MERGE * ("merge" in r.action) + chat.INSERT * (len(r.inserted.split(",")) if r.inserted else 0) for r in long)
    best = chat.transfer([chat.role_of(r[2]) for r in rows[:2000]])[0]
    assert cost == min(c + chat.end_cost(s)[0] for s, c in enumerate(best)) and [r.turn for r in long] == list(range(2000))
    other = {r.conv_id: r.rendered for r in got if r.conv_id in (6, None)}
    assert other[6] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and other[None].endswith("<|im_end|>\n")
    assert chat.repaired(df.limit(0)).count() == 0 and len(got) == len(rows)
    assert chat.chat_texts(chat.repaired(df)).count() == 4


def test_archive(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    assert spark_rows(warc.query(spark, data)) == duck_rows(warc.SQL, data)
    big = "long payload " * 20
    odd = spark.createDataFrame([(3, "u", big), (2, "v\r\nX: y", big), (2, "v", big), (None, None, big), (5, "w", None), (6, "w", ""), (7, "s",
        "short"), (8, "s", "short"), (None, "n", "é" * 60)], "page_id long, url string, html string")
    path = str(tmp_path / "odd")
    warc.write_archive(odd.withColumn("digest", F.lit("x")), path)
    got = {(r.page_id, r.payload_digest[:4], r.record_type, r.refers_to) for r in warc.archived(spark, path).collect()}
    d = hashlib.sha256(big.encode()).hexdigest()[:4]
    assert {(3, d, "revisit", 2), (2, d, "response", None), (None, d, "revisit", 2)} <= got and warc.archived(spark, path).count() == 9
    assert all(r[2] == "response" for r in got if r[0] in (5, 6, 7, 8)) and spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc.reconstruct(spark, path).collect()
    for r in records:  # every record is as long as its header says
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and block[size:] == b"\r\n\r\n" and block[:size] == (b"" if b"WARC-Type: revisit" in head else bytes(r.payload))
    assert {bytes(r.payload) for r in records if r.page_id == 3} == {big.encode()} and not any(b"\r\nX: y" in bytes(r.record) for r in records)
    assert {r.url for r in warc.read_records(spark, path).collect() if r.page_id == 2} == {"v\r\nX: y", "v"}
    empty = str(tmp_path / "none")
    warc.write_archive(pages.limit(0), empty)
    assert warc.archived(spark, empty).count() == 0


def chains(rows, least=0.8):
    """Row numbers of ``rows(doc_id, text)`` by group, by comparing all pairs of shingle sets."""
    sets, root = [set(near_copies.shingles(t or "").tolist()) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            either = len(sets[i]) + len(sets[j]) - both
            if not either or both / either >= least:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups.values()


def test_pipeline(spark, data, docs):
    """Each stage on what the one before kept, against brute force where a stage is not a model."""
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "source_mixing", "best_fit_packing"] and P.ORACLE_SQL is None
    good = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    kept = docs.where(F.col("doc_id").isin(sorted(good)))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    first = {min(rows[i][0] for i in group) for group in chains(rows)}
    assert len(first) < len(good)
    taken = {r.doc_id: r.taken for r in mixing.mixed_words(kept.where(F.col("doc_id").isin(sorted(first)))).collect() if r.taken}
    rows = P.run(spark, data).collect()
    assert {r.doc_id for r in rows} == set(taken) and max(r.length for r in rows) <= 2048
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(parts)[:i]) for parts in places.values() for i, (o, _) in enumerate(sorted(parts)))


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))
