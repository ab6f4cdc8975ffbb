"""TF-IDF retrieval by bounds against every document's weights, and what it writes."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from brindle.operators import maxscore, tfidf, tfidf_search


def grams(text):
    w = text.lower().split()
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def test_best_by_bound_are_the_best(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    popular = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, popular, k=rng.randrange(60))) for _ in range(400)] + ["W1 w2", "w1  w2", ""]
    asked = [" ".join(rng.choices(words, popular, k=rng.randrange(1, 12))) for _ in range(9)] + ["nothing known", ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    counts = [grams(t) for t in texts]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((2.0 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        return {t: x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}

    weights, want, hits = [unit(c) for c in counts], [], {}
    for i, q in enumerate(unit(grams(t)) for t in asked):
        scored = sorted((-round(sum(x * w[t] for t, x in q.items() if t in w), 9), j) for j, w in enumerate(weights) if q.keys() & w.keys())
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:3])]
        hits |= {i: len(scored)} if scored else {}
    found = []
    monkeypatch.setattr(tfidf_search, "kept", lambda rows, kind: found.append((kind, maxscore.kept(rows, kind))) or found[-1][1])
    for held, slots in ((20, 64), (1_000_000, 1 << 16)):
        monkeypatch.setattr(tfidf_search, "HELD_ENTRIES", held)
        monkeypatch.setattr(tfidf_search, "SLOTS", slots)
        found.clear()
        top, n = tfidf_search.topk(queries, docs, 3, tfidf.words("text"))
        got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in top.collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want))
        assert {r.qid: r.num_docs for r in n.collect()} == hits
        # ties of equal vectors go to the smaller id
        assert all(any(abs(x[3] - w[3]) < 1e-8 and x[2] == w[2] for x in got if x[0] == w[0]) for w in want)
    # exact terms are written for few documents
    rows = [df.select("id").distinct().count() for kind, df in found if kind == "found-terms"]
    assert rows and max(rows) < len(texts) / 2
    assert tfidf_search.topk(queries.limit(0), docs, 3, tfidf.words("text"))[0].count() == 0
    assert tfidf_search.topk(queries, docs.where(F.lit(False)), 3, tfidf.words("text"))[1].count() == 0


def test_most_frequent_terms(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghij", range(1, 11), k=rng.randrange(30))) for _ in range(60)] + ["", "A b"]
    counts = [grams(t) for t in texts]
    total, df = sum(counts, Counter()), Counter(t for c in counts for t in c)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # slots so few that the first look isn't enough; slots for each term; more terms than there are
    for slots, most in ((64, 12), (1 << 16, 12), (1 << 16, 500)):
        monkeypatch.setattr(tfidf_search, "SLOTS", slots)
        got = {r.term: r.idf for r in tfidf_search.most_frequent(docs, tfidf.words("text"), most).collect()}
        best = sorted(total, key=lambda t: (-total[t], t))[:most]
        assert set(got) == set(best) and all(abs(got[t] - math.log((1.0 + len(texts)) / (1 + df[t])) - 1) < 1e-9 for t in best)


def test_tables_go_to_python_in_small_batches(spark, data):
    from brindle.sources.tables import table

    table(spark, data, "region")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
