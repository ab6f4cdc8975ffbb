"""Queries that SQL can't express, on whole small tables, against plain Python; and cases that the tables lack."""

import hashlib
import html
import re
import time
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import chunking as C
from brindle.functions import text as X
from brindle.operators import cache, dedupe, guard, numbering, search
from brindle.plans import catalogue
from brindle.sources import tables as T

BLANKS = "[ \t\r 　]+"


def rows(spark, data, name):
    return catalogue.queries()[name](spark, data).collect()


def units(text):
    def grown(m):
        value = float(m[1]) * (1e3 if m[2] in "kK" else 1e6)
        return f"{int(value):,}" if value == int(value) else re.sub(r"\.?0+$", "", f"{value:,.3f}")

    return re.sub(r"\bNTD\s*(\d)", r"NTD \1", re.sub(r"\b(\d+(?:\.\d+)?)([kKmM])\b", grown, text).replace("NT$", "NTD "))


def normal(text):
    text = re.sub(r"([。？！；.!?;,，])\1+", r"\1", unicodedata.normalize("NFKC", text)).replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", units(re.sub(BLANKS, " ", text))).strip()


def test_normalize(spark, data):
    texts = {r.doc_id: r.text for r in T.table(spark, data, "documents").collect()}
    assert {r.doc_id: r.t for r in rows(spark, data, "normalize_text")} == {i: normal(t) for i, t in texts.items()}
    assert {r.doc_id: r.expanded for r in rows(spark, data, "num_units")} == {i: units(t) for i, t in texts.items()}


def reflowed(text):
    """Lines in groups: code, single lines, and paragraphs."""
    groups, code = [], False
    for line in text.split("\n"):
        fence = line.strip().startswith("```")
        alone = code or fence or not line.strip() or re.match(r"#{1,6}\s|[-*+]\s+|\d+\.\s+", line)
        if alone:
            groups.append((True, [line.rstrip()]))
        elif groups and not groups[-1][0]:
            groups[-1][1].append(line.strip())
        else:
            groups.append((False, [line.strip()]))
        code = code != fence
    out = ""
    for n, (alone, lines) in enumerate(groups):
        block = lines[0] if alone else re.sub(BLANKS, " ", " ".join(lines))
        gap = "" if not n else "\n" if out.endswith("\n") or not previous or not block.strip() else "\n\n"
        out, previous = out + gap + block, block
    return out.strip()


def test_reflow(spark, data):
    texts = {r.doc_id: r.text for r in T.table(spark, data, "documents").collect()}
    assert {r.doc_id: r.t for r in rows(spark, data, "reflow")} == {i: reflowed(t) for i, t in texts.items()}


DROPPED = ("script", "style", "nav", "aside", "footer", "header", "noscript", "template", "iframe")


def texts_of(page):
    """The texts between the tags of a page without its noise, entities read."""
    for tag in DROPPED:
        page = re.sub(rf"(?is)<{tag}\b.*?</{tag}\s*>", "<hr>", page)
    return [html.unescape(t) for t in re.split(r"(?s)<!--.*?-->|<[^>]+>", page) if t]


def test_pages(spark, data):
    """The exact texts and the exact paragraphs of every page."""
    pages = {r.page_id: r.html for r in T.table(spark, data, "pages").collect()}
    blocks = {r.page_id: r.t for r in rows(spark, data, "html_blocks")}
    assert blocks == {i: "\n\n".join(texts_of(p)) for i, p in pages.items()}
    df = spark.createDataFrame([("<nav>a<nav>b</nav>c</nav><p>k&eacute;ep &#8364;&copy; <b>it</b></p><header>x<p>y</header>z",)], "text string")
    assert df.select(X.html_blocks("text")).first()[0] == "kéep €©\u0020\n\nit\n\nz"
    clean = {}
    for r in rows(spark, data, "clean_document"):
        clean.setdefault(r.page_id, []).append((r.pos, r.text))
    for page, source in pages.items():
        parts = [t for t in texts_of(source)]
        assert not any(k in t for t in parts for k in X.NOISE_KEYWORDS) or page in clean
        if any(k in t for t in parts for k in X.NOISE_KEYWORDS):
            continue  # words of navigation: below
        lines = [p.strip() for p in reflowed(normal("\n\n".join(parts))).split("\n")]
        assert [t for _, t in sorted(clean.get(page, []))] == list(dict.fromkeys(p for p in lines if len(p) >= 10)), page
    page = "<h2>Next page of it all</h2><p>廣告</p><p>A paragraph of text, 10K long!!</p><script>no</script><p>A paragraph of text, 10K long!!</p><p>short</p>"
    assert spark.createDataFrame([(page,)], "t string").select(X.clean_document("t")).first()[0] == ["A paragraph of text, 10,000 long!"]


def test_likeness(spark, data):
    items = {r.item_id: r.text for r in T.table(spark, data, "benchmark").collect()}
    score = lambda a, b: round(SequenceMatcher(None, a, b).ratio() * 100, 6)
    assert {r.item_id: r.score for r in rows(spark, data, "ratcliff_similarity")} == {i: score(items[i], items[i + 1]) for i in items if i + 1 in items}
    want = {}
    for q in items:
        if q % 20 == 0:
            want[q] = max((score(items[q], t), -i) for i, t in items.items() if i != q)
    assert {r.qid: (r.score, -r.item_id) for r in rows(spark, data, "kb_best_match")} == want


def test_contexts(spark, data):
    def vector(text):
        v = np.zeros(384)
        for token in text.split():
            h = int(hashlib.sha1(token.encode()).hexdigest(), 16)
            v[h % 384] += 1 if h & 2 else -1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).astype(np.float32).astype(np.float64)

    chunks = []
    for r in T.table(spark, data, "documents").collect():
        at = 0
        while r.text and (at == 0 or at + 100 < len(r.text)):
            chunks.append((f"{r.doc_id}:{len(chunks):09d}", r.text[at : at + 1000]))
            at += 900
    base = np.stack([vector(t) for _, t in chunks])
    got = {r.qid: r.context for r in rows(spark, data, "answer_contexts")}
    items = T.table(spark, data, "benchmark").collect()
    assert len(got) == len(items)
    for r in items:
        scores = base @ vector(r.text)
        best = sorted(scores, reverse=True)[:3]
        texts = {t for (_, t), s in zip(chunks, scores) if s >= best[-1] - 1e-9}
        found = got[r.item_id].split("\n\n")
        assert all(any(part in t for t in texts) for part in found) and "\n\n".join(found) == got[r.item_id]


@pytest.mark.parametrize("name", ["packed_lines", "packed_sentences", "by_topic", "by_rules", "sliding", "fixed"])
def test_long_texts_take_linear_time(spark, name):
    cut = {"packed_lines": C.packed_lines, "packed_sentences": lambda c: C.packed_sentences(c, 200, 40, "."), "by_topic": lambda c: C.by_topic(c,
        ("x1",), ".", "."), "by_rules": lambda c: C.by_rules(c, "^zz"), "sliding": C.sliding, "fixed": C.fixed}[name]
    text = "\n".join(f"word x{i}. And more." for i in range(100_000))
    df = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    chunks = df.select(cut("text")).first()[0]
    assert chunks and time.time() - began < 20


def test_unicode_space_and_digits(spark):
    df = spark.createDataFrame([("a　 b\xa0c \x1f　",), (" x y\x85",)], "t string")
    assert [r[0] for r in df.select(X.norm_ws("t")).collect()] == ["a b c", "x y"]
    assert df.select(X.content_hash("t")).first()[0] == hashlib.sha256(b"a b c").hexdigest()
    full = spark.createDataFrame([("call ０９１２-３４５-６７８ or +８８６　２ １２３４ ５６７８ now",)], "t string").select(X.redact("t").alias("r")).first().r
    assert full.text == f"call {X.PHONE_MARK} or {X.PHONE_MARK} now" and full.stats["phone"] == 2


def test_numbers_across_slices(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SLICE_ROWS", 7)
    df = spark.createDataFrame([(i * 3 % 101,) for i in range(101)] + [(None,)], "o long")
    assert sorted(((r.o, r.n) for r in numbering.numbered(df, "o", "n").collect()), key=lambda x: x[1]) == [(None, 1)] + [(i, i + 2) for i in range(101)]
    new = spark.createDataFrame([(i, "q", "a", [1.0]) for i in range(50)], "o long, q string, a string, v array<double>")
    old = spark.createDataFrame([(5, "q", "a", [1.0])], "id long, q string, a string, v array<double>")
    assert sorted(r.id for r in cache.insert_vectors(old, new, "o").collect()) == list(range(5, 56))
    assert [r.o for r in dedupe.new_slice(df.where("o is not null"), "o", 98).orderBy("o").collect()] == [98, 99, 100]


def test_ties_in_search(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORE_CELLS", 12)
    base = spark.createDataFrame([(f"k{i:02d}", [1.0, float(i % 2)]) for i in range(40)], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "qid long, embedding array<double>")
    got = {(r.qid, r["rank"]): r.vec_id for r in search.topk(q, base, 3, "dot").collect()}
    assert [got[0, k] for k in (1, 2, 3)] == ["k00", "k01", "k02"] and [got[2, k] for k in (1, 2, 3)] == ["k01", "k03", "k05"] == [got[1, k] for k in (1, 2, 3)]


def test_files(spark, tmp_path):
    (tmp_path / "blank.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert T.json_lines(spark, str(tmp_path / "blank.jsonl"), "a int").count() == 2
    with pytest.raises(Exception, match="blank line"):
        T.json_lines(spark, str(tmp_path / "blank.jsonl"), "a int", strict=True).collect()
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_text("x")
    digest = T.bundle(spark, str(tmp_path / "files"), str(tmp_path / "out.tar.gz"))
    assert digest == "sha256:" + hashlib.sha256((tmp_path / "out.tar.gz").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="no items"):
        T.write_index(spark.createDataFrame([], "id long, chunk string, vector array<float>"), str(tmp_path / "i"), "s", "m", "now")
        T.read_index(spark, str(tmp_path / "i"))
    with pytest.raises(Exception, match="as many vectors"):
        search.zipped(spark.createDataFrame([(1, "a")], "i int, t string"), spark.createDataFrame([(2, "v")], "i int, v string"), ["i"]).collect()


def test_policy_is_read_for_each_batch(spark):
    batch = spark.createDataFrame([("bad word",)], "text string")
    rules, seen = [spark.createDataFrame([("input", 0, "nothing")], "stage string, ord int, pattern string")], []
    check = guard.checked_by(lambda: rules[-1], lambda df, n: seen.append(df.first().gate.blocked))
    check(batch, 0)
    rules.append(spark.createDataFrame([("input", 0, "bad")], "stage string, ord int, pattern string"))
    check(batch, 1)
    assert seen == [False, True]


def test_search_is_bounded_in_memory(spark, monkeypatch):
    """whatever the queries and rows of a batch, a task's scores and what is made of them stay small, and the result exact."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    queries, base = rng.integers(-50, 50, (3000, 4)), rng.integers(-50, 50, (2000, 4))
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid long, embedding array<float>")
    b = spark.createDataFrame([(0, [0.0] * 4)], "vec_id long, embedding array<float>")
    works, real = [], type(b).mapInArrow
    monkeypatch.setattr(type(b), "mapInArrow", lambda self, work, *a: works.append(work) or real(self, work, *a))
    search.topk(q, b, 10, "dot")
    vectors = pa.array(base.astype("float32").tolist(), pa.list_(pa.float32()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(2000)), vectors], ["vec_id", "embedding"])
    got = sorted(tuple(r.values()) for work in works for out in work(iter([rows.slice(0, 1000), rows.slice(1000)])) for r in out.to_pylist())
    order = np.lexsort((np.broadcast_to(np.arange(2000), (3000, 2000)), -(queries @ base.T)))[:, :10]
    assert [g[:2] for g in got] == sorted((i, int(j)) for i, row in enumerate(order) for j in row)
    tracemalloc.start()
    for work in works:
        for out in work(iter([rows.slice(0, 1000), rows.slice(1000)])):
            pass
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
