"""Language detection and segmentation."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import segment
from brindle.operators import language, maxscore, tfidf
from brindle.plans import language_queries

from .test_bruteforce import normal, reflowed


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return language.fit(docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 2 = 1 and lang is not null")
    rows = language.detected(docs, model).select("lang", "language").collect()
    assert len(rows) > 50 and sum(r.lang == r.language for r in rows) >= 0.95 * len(rows)


def test_short_and_empty_texts(spark, model):
    assert model.detect(None) == model.detect("") == model.detect(" 12 .. ") == model.detect("中文") == language.UNKNOWN
    assert language.fit(spark.createDataFrame([(None, "en"), ("x", None), (" ", "en")], "text string, lang string")).detect("words") == language.UNKNOWN
    rows = spark.createDataFrame([(1, "the and of with that"), (2, ""), (3, "12 34"), (4, None)], "id long, text string")
    kept = language.in_languages(rows, model, ["en-US"])
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 3] and kept.columns == rows.columns
    assert "en" in model.languages and [r.id for r in language.in_languages(rows, model, ["zh"]).collect()] == [3]
    assert language.in_languages(rows, model, []).count() == 2


def test_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("concat('word', id, ' some letters') as text",
        "'en' as lang").union(spark.range(50).selectExpr("concat('zz qq ', id) as text", "'xx' as lang"))
    m = language.fit(df, sample=100, kept=50)
    assert len(m.grams) <= 100 and m.detect("some letters") == "en" and m.detect("zz qq") == "xx"


def test_clean_paragraphs(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    twice = spark.createDataFrame([(-1, "A  heading that is long\n\nA  heading that is long\nshort\nwords that are\njoined here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.clean_paragraphs(docs.union(twice), model, ["en"], is_html=False).collect()}
    for r in rows.values():
        lines = [p.strip() for p in reflowed(normal(r.text or "")).split("\n")]
        want = list(dict.fromkeys(p for p in lines if p and model.detect(p) in ("en", language.UNKNOWN) and len(p) >= 10))
        assert list(r.paragraphs or []) == want, r.doc_id
    assert rows[-1].paragraphs and any(len(r.paragraphs or []) == 0 for r in rows.values())
    every = {r.doc_id: r.paragraphs for r in language.clean_paragraphs(docs, model, [], is_html=False).collect()}
    assert all(set(rows[i].paragraphs or []) <= set(p or []) for i, p in every.items())
    counts = {r.doc_id: r.n for r in language_queries.clean_paragraphs(spark, data).collect()}
    assert len(counts) == len(every)


def likeliest(text, counts):
    """The best of all ways to cut a text."""
    total = sum(counts.values())
    best = None
    for marks in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, m in enumerate(marks, 1):
            if m:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        if all(p in counts or len(p) == 1 for p in parts):
            score = sum(math.log(counts[p] / total) if p in counts else math.log(0.5 / total) for p in parts)
            if best is None or score > best:
                best = score
    return best


def test_segmentation_is_the_likeliest():
    rng = random.Random(3)
    for _ in range(300):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(8)}
        dictionary, total = segment.Dictionary(dict(counts)), sum(counts.values())
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        cut = dictionary.cut(text)
        assert "".join(cut) == text
        score = sum(math.log(counts[w] / total) if w in counts else math.log(0.5 / total) for w in cut)
        assert abs(score - likeliest(text, counts)) < 1e-9
    assert segment.Dictionary({}).cut("ab") == ["a", "b"] and segment.Dictionary({}).cut("") == []


COUNTS = {"公司": 900, "設定": 700, "密碼": 500, "登入": 500, "系統": 600, "請假": 400, "流程": 500, "如何": 800, "怎麼": 700, "我要": 600, "怎麼辦": 300, "多少": 500,
    "下載": 300, "新版": 200, "客戶": 400, "客戶端": 100, "提交": 300, "假單": 50, "並": 900, "以": 2000}


def test_words_with_a_users_dictionary(spark):
    plain, own = segment.Dictionary(dict(COUNTS)), segment.Dictionary(dict(COUNTS), ["請假流程"])
    assert segment.words("公司 VPN 設定：下載新版客戶端", plain) == ["公司", "vpn", "設定", "下載", "新版", "客戶端"]
    assert segment.words("請假流程：登入 HR 系統", plain) == ["請假", "流程", "登入", "hr", "系統"] and segment.words("請假流程", own) == ["請假流程"]
    with pytest.raises(ValueError):
        segment.Dictionary({"a" * (segment.MOST_CHARS + 1): 1})


def test_segmentation_lifts_the_scores(spark):
    """Questions in Chinese find the text that answers them by words, and hardly by what lies between spaces."""
    texts = ["公司 VPN 設定：下載新版客戶端，並以 SSO 登入。", "請假流程：登入 HR 系統提交假單。", "公司 Wi-Fi 密碼：請以系統登入，下載設定。", "新版系統如何下載", "客戶提交多少"]
    questions = ["如何設定公司 VPN？", "我要請假要怎麼辦？", "公司 Wi-Fi 密碼多少？"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "doc_id long, text string")

    def best(terms):
        counts = tfidf.term_counts(docs, "doc_id", terms)
        idf = tfidf.fit(counts, len(texts))
        w = tfidf.weigh(counts, idf).withColumnRenamed("id", "doc_id")
        q = tfidf.weigh(tfidf.term_counts(asked, "doc_id", terms), idf).withColumnRenamed("id", "qid")
        return {r.qid: (r.doc_id, r.score) for r in maxscore.sparse_topk(q, w, 1).collect()}

    before, after = best(tfidf.word_grams("text")), best(segment.grams_of(segment.segmented(spark, "text", COUNTS)))
    assert [after[i][0] for i in range(3)] == [0, 1, 2]
    # the third has words between spaces in common with its answer anyway
    assert all(after[i][1] > before.get(i, (None, 0.0))[1] + 0.1 for i in range(2)) and after[2][1] > 0.5


def test_segmented_words(spark, data):
    rows = {r.item_id: r.words for r in language_queries.segmented_words(spark, data).collect()}
    text = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    dictionary = segment.Dictionary(dict(language_queries._dictionary(spark, data)))
    for i, t in text.items():
        assert rows[i] == " ".join(segment.words(t.lower().replace(" ", ""), dictionary, language_queries.LETTERS))
    assert sum(len(set(w.split()) & set(text[i].lower().replace(".", " ").replace(",", " ").split())) for i, w in rows.items()) > 0


def test_texts_are_scored_together_as_one_by_one(model):
    """Scores are those of adding each text's n-grams up in the order in which they are found, to the last bit; with n-grams looked up directly and by search."""
    rnd = random.Random(3)
    odd = "abcé ΣσςİıA1²½。\n\t'ﬁ漢한\U00010400　"
    texts = ["".join(rnd.choices(odd, k=rnd.randrange(9))) for _ in range(300)] + ["the house of the people " * 40, "la casa de la gente"] * 3

    def plainly(text):
        total = sum((n * model.grams[g] for g, n in language.grams(text).items() if g in model.grams), start=model.grams["e"] * 0)
        order = total.argsort(kind="stable")
        ahead = len(total) < 2 or total[order[-1]] > total[order[-2]]
        return total, model.languages[total.argmax()] if any(map(str.isalpha, text)) and ahead else language.UNKNOWN

    want = [plainly(t) for t in texts]
    for direct in (language.DIRECT, 0):
        one = language.Model(model.languages, model.grams)
        language.DIRECT, before = direct, language.DIRECT
        try:
            scores, spoken = one.scores(texts)
        finally:
            language.DIRECT = before
        assert all((s == w).all() for s, (w, _), any_letter in zip(scores, want, spoken) if any_letter)
        assert one.detect_all(texts) == [w for _, w in want]


def test_a_small_base_is_held_and_a_large_one_searched_by_lists(spark, monkeypatch):
    """The likeness in a text's row is that of the search by inverted lists; a base that tasks can't hold has none."""
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choices("abcde \té漢\U00010400", k=n))
    base = spark.createDataFrame([(i, text(30)) for i in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(rnd.randrange(60))) for i in range(40)] + [(40, None), (41, ""), (42, "zz"), (43, "A"), (44, " ")], "qid long, text string")
    counts = tfidf.term_counts(base, "doc_id", tfidf.char_grams("text"))
    idf = tfidf.fit(counts, 12)
    weights = tfidf.weigh(counts, idf).withColumnRenamed("id", "doc_id")
    got = {r.qid: r.s for r in asked.select("qid", F.round(tfidf.best_likeness(idf, weights)("text"), 6).alias("s")).collect() if r.s is not None}
    q = tfidf.weigh(tfidf.term_counts(asked, "qid", tfidf.char_grams("text")), idf).withColumnRenamed("id", "qid")
    want = {r.qid: r.score for r in maxscore.sparse_topk(q, weights, 1, digits=6).collect()}
    assert got == pytest.approx(want, abs=1.1e-6) and {40, 41, 42}.isdisjoint(got) and 43 in got
    monkeypatch.setattr(tfidf, "HELD_WEIGHTS", 10)
    assert tfidf.best_likeness(idf, weights) is None
