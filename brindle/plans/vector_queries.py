"""Queries over vectors and retrieval, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import vectors as V
from ..functions.similarity import ratcliff
from ..functions.text import WS, content_hash
from ..operators import context, tfidf_search
from ..operators import search as S
from ..operators import maxscore as M
from ..operators import tfidf as I
from ..operators.dedupe import drifted
from ..sources.tables import table

K = 5
_DBL = "CAST({0}.embedding AS DOUBLE[])"
_WS = WS.replace("{", "{{").replace("}", "}}")
_NORM = f"regexp_replace(regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')"


def _both(s, d):
    """Every vector whose id is divisible by 20 as a query, all vectors as the base."""
    base = table(s, d, "embeddings")
    return base.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), base


def _top(metric):
    def run(s, d):
        q, b = _both(s, d)
        return S.topk(q, b, K, metric).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")

    return run


_SCORES = {
    "cosine": "list_dot_product({q}, {b}) / (sqrt(list_dot_product({q}, {q})) * sqrt(list_dot_product({b}, {b})))",
    "l2sq": "list_dot_product({q}, {q}) - 2 * list_dot_product({q}, {b}) + list_dot_product({b}, {b})",
}
_SCORES["l2"] = f"sqrt(greatest({_SCORES['l2sq']}, 0))"
_SCORES["l2sq"] = f"greatest({_SCORES['l2sq']}, 0)"


def _ranked_sql(metric, k=K):
    score = _SCORES[metric].format(q=_DBL.format("q"), b=_DBL.format("b"))
    order = "DESC" if metric == "cosine" else "ASC"
    return f"SELECT qid, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score {order}, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, b.vec_id, {score} AS score FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)) WHERE rank <= {k}"


def _top_sql(metric):
    return f"SELECT qid, vec_id, round(score, 6) AS score, rank FROM ({_ranked_sql(metric)})"


def topk_overlap(s, d):
    q, b = _both(s, d)
    return S.overlap(S.topk(q, b, K, "cosine"), S.topk(q, b, K, "l2sq")).select("qid", "n_common")


def nearest_threshold(s, d):
    """The best other vector of each query, where its cosine is at least 0.3."""
    q, b = _both(s, d)
    ranked = S.topk(q, b, 2, "cosine").where("vec_id <> qid")
    best = ranked.groupBy("qid").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b"))
    return S.nearest_above(best.select("qid", "b.*", F.lit(1).alias("rank")), 0.3).select("qid", "vec_id", F.round("score", 6).alias("score"))


def distance_gate(s, d):
    q, b = _both(s, d)
    top = S.topk(q, b, 1, "l2sq")
    labels = b.select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    return S.distance_gate(top.join(labels, "vec_id"), F.col("text"), 1.8, "no answer").select("qid", "answer")


def overfetch_dedupe(s, d):
    """The 5 nearest of 25 whose texts differ; a vector's text is the document of the same id."""
    q, b = _both(s, d)
    hashes = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), content_hash("text").alias("text_hash"))
    pool = S.topk(q, b, 25, "cosine").join(hashes, "vec_id")
    return S.overfetch_dedupe(pool, "text_hash", K).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_label_vote(s, d):
    q, b = _both(s, d)
    return S.knn_votes(S.topk(q, b, 10, "cosine"), b.select("vec_id", "label"))


def consecutive_cosine(s, d):
    """Cosine, in three conventions for zero vectors, of each vector and the one whose id is next."""
    b = table(s, d, "embeddings")
    pairs = b.select(F.col("vec_id"), F.col("embedding").alias("x")).join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(V.cosine("x", "y"), 6).alias("plain"), F.round(V.cosine("x", "y", "one"), 6).alias("guarded"),
        F.round(V.cosine("x", "y", "eps"), 6).alias("eps"), F.round(V.l2("x", "y"), 6).alias("l2"), F.round(V.similarity_of_l2sq(V.l2sq("x", "y")),
        6).alias("from_l2"))


CONSECUTIVE_SQL = f"""
WITH p AS (SELECT a.vec_id, {_DBL.format('a')} AS x, {_DBL.format('b')} AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
q AS (SELECT vec_id, list_dot_product(x, y) AS d, sqrt(list_dot_product(x, x)) AS nx, sqrt(list_dot_product(y, y)) AS ny, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS s FROM p)
SELECT vec_id, round(d / (nx * ny), 6) AS plain, round(d / (nx * ny), 6) AS guarded, round(d / ((nx + 1e-8) * (ny + 1e-8)), 6) AS eps, round(sqrt(s), 6) AS l2, round(1 - s / 2, 6) AS from_l2 FROM q
"""


def l2_normalize(s, d):
    """The first and the sum of the elements of each normalised vector."""
    b = table(s, d, "embeddings").select("vec_id", V.normalized("embedding").alias("v"))
    return b.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def fitted_vectors(s, d):
    b = table(s, d, "embeddings").select("vec_id", V.fitted("embedding", 16).alias("short"), V.fitted("embedding", 80).alias("long"))
    return b.select("vec_id", F.round(F.col("short")[3], 6).alias("short_4"), F.size("long").alias("long_size"))


def label_similarity(s, d):
    """Mean, least and greatest cosine of the 10 nearest, by the query's label."""
    q, b = _both(s, d)
    ranked = S.topk(q, b, 10, "cosine").where("vec_id <> qid").join(q.select("qid", "label"), "qid")
    return ranked.groupBy("label").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("greatest"))


def _tfidf(docs, doc_id, grams, n_docs, max_features=None):
    counts = I.term_counts(docs, doc_id, grams)
    return I.weigh(counts, I.fit(counts, n_docs, max_features))


def tfidf_char_pairs(s, d):
    """TF-IDF likeness, by character 1- to 3-grams, of each benchmark item divisible by 20 to every item."""
    b = table(s, d, "benchmark")
    w = _tfidf(b, "item_id", I.char_grams("text"), b.count())
    q = w.where("id % 20 = 0").withColumnRenamed("id", "qid")
    return S.sparse_cosine(q, w.withColumnRenamed("id", "doc_id")).select("qid", "doc_id", F.round("score", 6).alias("score"))


_CHAR_GRAMS = r"""WITH t AS (SELECT item_id AS id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark),
g AS (SELECT id, unnest(flatten([list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))])) AS term FROM t),"""
_WEIGHTS = """c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL),
i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
r AS (SELECT id, term, tf * idf AS w FROM c JOIN i USING (term)),
l AS (SELECT id, sqrt(sum(w * w)) AS l FROM r GROUP BY id),
w AS (SELECT id, term, w / l AS w FROM r JOIN l USING (id))"""


def _documents_tfidf(s, d):
    docs, items = table(s, d, "documents"), table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    top, hits = tfidf_search.topk(items, docs, 3, I.words("text"))
    return I.signals(top, hits, items.select("qid"), docs.select("doc_id", "text"), 3)


def tfidf_word_signals(s, d):
    """Retrieval signals of every benchmark item against all documents, by words and word pairs."""
    return _documents_tfidf(s, d).select("qid", F.round("max_score", 6).alias("max_score"), F.round("avg_topk", 6).alias("avg_topk"), "num_docs", "context_len")


def route_decision(s, d):
    return I.route(_documents_tfidf(s, d)).select("qid", "target")


_SIGNALS = r"""WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w, length(text) AS n FROM documents),
b AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL),
i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
r AS (SELECT id, term, tf * idf AS w FROM c JOIN i USING (term)),
l AS (SELECT id, sqrt(sum(w * w)) AS l FROM r GROUP BY id),
w AS (SELECT id, term, w / l AS w FROM r JOIN l USING (id)),
qg AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM b),
qc AS (SELECT id, term, count(*) AS tf FROM qg GROUP BY ALL),
qr AS (SELECT id, term, tf * idf AS w FROM qc JOIN i USING (term)),
ql AS (SELECT id, sqrt(sum(w * w)) AS l FROM qr GROUP BY id),
qw AS (SELECT id, term, w / l AS w FROM qr JOIN ql USING (id)),
s AS (SELECT qw.id AS qid, w.id AS doc_id, sum(qw.w * w.w) AS score FROM qw JOIN w USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY qid) AS num_docs FROM s),
o AS (SELECT qid, max(score) AS max_score, avg(score) AS avg_topk, max(num_docs) AS num_docs, CAST(sum(t.n) AS BIGINT) AS context_len FROM k JOIN t ON t.id = doc_id WHERE r <= 3 GROUP BY qid)"""


def kb_best_match(s, d):
    """The benchmark item most like each item divisible by 20, by matching blocks, other than itself."""
    b = table(s, d, "benchmark")
    q = b.where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")
    return S.best_alike(q, b.select(F.col("item_id").alias("id"), "text")).select("qid", F.col("id").alias("item_id"), F.round("score", 6).alias("score"))


def ratcliff_similarity(s, d):
    """Likeness of each benchmark item to the one whose id is next."""
    b = table(s, d, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next")), "item_id")
    return pairs.select("item_id", F.round(ratcliff("text", "next") * 100, 6).alias("score"))


def tfidf_char_topk(s, d):
    """The 3 items most like each benchmark item divisible by 20, with the distance."""
    b = table(s, d, "benchmark")
    w = _tfidf(b, "item_id", I.char_grams("text"), b.count())
    best = M.sparse_topk(w.where("id % 20 = 0").withColumnRenamed("id", "qid"), w.withColumnRenamed("id", "doc_id"), 3, digits=6)
    return best.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round(1 - F.col("score"), 6).alias("distance"))


def tfidf_features(s, d):
    """The 20,000 most frequent words and word pairs of all documents, with their weights."""
    docs = table(s, d, "documents")
    return tfidf_search.most_frequent(docs, I.words("text"), 20_000).select("term", F.round("idf", 6).alias("idf"))


def hash_embed_topk(s, d):
    """The 5 documents most like each benchmark item divisible by 20, by hashed vectors."""
    docs = table(s, d, "documents").select("doc_id", V.hash_vector("text").alias("embedding"))
    items = table(s, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("doc_id"), V.hash_vector("text").alias("embedding"))
    best = S.topk(items, docs, K, "dot", "doc_id", "doc_id", digits=6)
    return best.where("score <> 0").select("qid", F.col("vec_id").alias("doc_id"), "score")


def _best_chunks(s, d):
    item = table(s, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    near = hash_embed_topk(s, d).select("qid", "doc_id")
    found = table(s, d, "documents").join(near.select("doc_id").distinct(), "doc_id", "left_semi")  # only these are cut
    chunks = C.rows(found, C.sliding("text", 400, 100)).join(near, "doc_id").join(item, "qid")
    score = F.size(F.array_intersect("words", F.split(F.lower("text"), " "))).cast("double") / F.size("words")
    return S.top_chunks(chunks, F.round(score, 6), 3)


def chunk_rescoring(s, d):
    """The 3 chunks of each benchmark item's nearest documents that hold most of its words."""
    return _best_chunks(s, d).select("qid", "doc_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def chunk_prompts(s, d):
    """Each benchmark item as a question over its best chunks."""
    joined = context.joined(_best_chunks(s, d), ["qid"], "rank", sep=context.SNIPPET_SEPARATOR)
    items = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return joined.join(items, "qid").select("qid", context.snippet_prompt(F.col("question"), F.col("context"), context.CHUNK_LEAD).alias("prompt"))


def rerank(s, d):
    """The 10 nearest vectors of each query in falling order of their label, then of their place before."""
    q, b = _both(s, d)
    top = S.topk(q, b, 10, "cosine").withColumnRenamed("rank", "pos").join(b.select("vec_id", "label"), "vec_id")
    return S.rerank(top, F.col("label").cast("double"), "qid").select("qid", "vec_id", F.col("rank").cast("long").alias("rank"))


def zipped_vectors(s, d):
    """Documents beside the vectors of the same id."""
    b = table(s, d, "embeddings")
    docs = table(s, d, "documents").join(b.select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id", "lang")
    there = b.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc_id"), "label")
    return S.zipped(docs, there, ["doc_id"])


def drift_gate(s, d):
    """Whether each vector is unlike the one whose id is next."""
    b = table(s, d, "embeddings")
    pairs = b.select("vec_id", F.col("embedding").alias("x")).join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return drifted(pairs, V.cosine("x", "y"), 0.1).select("vec_id", "drift")


def filtered_topk(s, d):
    """The 5 nearest vectors of label 3, with their label: a search under a condition on metadata."""
    q, b = _both(s, d)
    top = S.topk(q, b.where("label = 3"), K, "cosine")
    return top.join(b.select("vec_id", "label"), "vec_id").select("qid", "vec_id", F.round("score", 6).alias("score"), "label")


def collection_stats(s, d):
    b = table(s, d, "embeddings")
    return b.agg(F.count("*").alias("total_count"), F.first(F.size("embedding")).alias("dims"))


def keyword_docs(s, d):
    return S.keyword_docs(table(s, d, "documents").select("doc_id", "text"), {"license": "doc_licence", "token": "doc_secret", "the": "doc_en"},
        "doc_any").select("doc_id", F.array_join("doc_ids", ",").alias("docs"))


_CHARS_TOP = f"s AS (SELECT a.id AS qid, b.id AS doc_id, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b USING (term) WHERE a.id % 20 = 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)"
_HASHED = r"""h{0} AS (SELECT {1} AS id, sha1(tok) AS h FROM (SELECT {1}, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS tok FROM {2})),
g{0} AS (SELECT id, CAST(('0x' || h[39:40]) AS INTEGER) AS low, list_sum(list_transform(range(1, 41), lambda i: CAST(('0x' || h[i:i]) AS INTEGER))) AS s FROM h{0}),
v{0} AS (SELECT id, low % 128 + 128 * ((2 * (s % 3 - low % 128) % 3 + 3) % 3) AS slot, sum(CASE WHEN (low & 2) > 0 THEN 1 ELSE -1 END) AS v FROM g{0} GROUP BY ALL),
n{0} AS (SELECT id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM v{0})"""
_NEAR = "WITH " + _HASHED.format("d", "doc_id", "documents") + ", " + _HASHED.format("q", "item_id", "(SELECT * FROM benchmark WHERE item_id % 20 = 0)") + f""",
s AS (SELECT q.id AS qid, d.id AS doc_id, round(sum(q.v * d.v), 6) AS score FROM nq q JOIN nd d USING (slot) WHERE q.v <> 0 AND d.v <> 0 GROUP BY ALL),
near AS (SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= {K})"""

_BEST_CHUNKS = _NEAR + """, c AS (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE 1 + ceil(greatest(length(text) - 400, 0) / 300) END AS BIGINT))) AS i FROM documents), e AS (SELECT n.qid, c.doc_id, substr(c.text, i * 300 + 1, 400) AS part, b.text AS question, CAST(i AS INTEGER) AS chunk_id, list_distinct(string_split(lower(b.text), ' ')) AS w, string_split(lower(substr(c.text, i * 300 + 1, 400)), ' ') AS x FROM near n JOIN c USING (doc_id) JOIN benchmark b ON b.item_id = n.qid), r AS (SELECT qid, doc_id, chunk_id, part, question, round(len(list_filter(w, lambda a: list_contains(x, a))) / len(w), 6) AS score FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_id) AS rank FROM r)"""

QUERIES = {
    "topk_cosine": (_top("cosine"), _top_sql("cosine")),
    "topk_l2": (_top("l2"), _top_sql("l2")),
    "ratcliff_similarity": (ratcliff_similarity, None),
    "tfidf_char_topk": (tfidf_char_topk, f"{_CHAR_GRAMS}{_WEIGHTS}, {_CHARS_TOP} SELECT qid, doc_id, rank, round(1 - score, 6) AS distance FROM k WHERE rank <= 3"),
    "tfidf_features": (tfidf_features,
        _SIGNALS.split("i AS (SELECT")[0] + "f AS (SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 20000) SELECT term, round(ln((1.0 + (SELECT count(*) "
        "FROM t)) / (1 + df)) + 1, 6) AS idf FROM f"),
    "hash_embed_topk": (hash_embed_topk, f"{_NEAR} SELECT * FROM near"),
    "chunk_rescoring": (chunk_rescoring, f"{_BEST_CHUNKS} SELECT qid, doc_id, chunk_id, score, rank FROM k WHERE rank <= 3"),
    "chunk_prompts": (chunk_prompts, f"{_BEST_CHUNKS} SELECT qid, "
        f"'{context.SNIPPET_TASK.format(context.CHUNK_LEAD[0])}' || any_value(question) || chr(10) || chr(10) || '{context.CHUNK_LEAD[1]}：' || chr(10) || string_agg(part, "
        f"'{context.SNIPPET_SEPARATOR}' ORDER BY rank) || '{context.ANSWER_TASK}' AS prompt FROM k WHERE rank <= 3 GROUP BY qid"),
    "rerank": (rerank,
        f"SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY label DESC, rank) AS rank FROM ({_ranked_sql('cosine', 10)}) "
        f"JOIN embeddings USING (vec_id)"),
    "zipped_vectors": (zipped_vectors, "SELECT doc_id, lang, label FROM documents JOIN embeddings ON vec_id = doc_id"),
    "drift_gate": (drift_gate, f"SELECT a.vec_id, list_cosine_similarity({_DBL.format('a')}, {_DBL.format('b')}) < 0.1 AS drift FROM embeddings a "
        f"JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "filtered_topk": (filtered_topk, f"SELECT qid, vec_id, round(score, 6) AS score, CAST(3 AS INTEGER) AS label "
        f"FROM ({_ranked_sql('cosine').replace('WHERE q.vec_id % 20 = 0', 'WHERE q.vec_id % 20 = 0 AND b.label = 3')})"),
    "collection_stats": (collection_stats, "SELECT count(*) AS total_count, CAST(max(len(embedding)) AS INTEGER) AS dims FROM embeddings"),
    "keyword_docs": (keyword_docs,
        "SELECT doc_id, CASE WHEN k = '' THEN 'doc_any' ELSE k END AS docs FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, "
        "'(?i)license') THEN 'doc_licence' END, CASE WHEN regexp_matches(text, '(?i)token') THEN 'doc_secret' END, CASE WHEN regexp_matches(text, '(?i)the') "
        "THEN 'doc_en' END], lambda x: x IS NOT NULL), ',') AS k FROM documents)"),
    "topk_l2sq": (_top("l2sq"), _top_sql("l2sq")),
    "topk_overlap": (topk_overlap, f"SELECT qid, count(*) AS n_common FROM ({_ranked_sql('cosine')}) a JOIN ({_ranked_sql('l2sq')}) b USING (qid, vec_id) GROUP BY qid"),
    "nearest_threshold": (nearest_threshold,
        f"SELECT qid, arg_max(vec_id, score) AS vec_id, round(max(score), 6) AS score FROM ({_ranked_sql('cosine', 2)}) WHERE vec_id <> qid "
        f"GROUP BY qid HAVING max(score) >= 0.3"),
    "distance_gate": (distance_gate,
        f"SELECT qid, CASE WHEN score > 1.8 THEN 'no answer' ELSE 'label ' || label END AS answer FROM ({_ranked_sql('l2sq', 1)}) JOIN embeddings USING (vec_id)"),
    "overfetch_dedupe": (overfetch_dedupe,
        f"WITH p AS (SELECT qid, vec_id, score, rank, sha256({_NORM.format('text')}) AS h FROM ({_ranked_sql('cosine', 25)}) "
        f"JOIN documents ON doc_id = vec_id), f AS (SELECT *, row_number() OVER (PARTITION BY qid, h ORDER BY rank) AS n FROM p), r AS (SELECT *, "
        f"CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS r FROM f WHERE n = 1) SELECT qid, vec_id, round(score, 6) AS score, r AS rank "
        f"FROM r WHERE r <= {K}"),
    "knn_label_vote": (knn_label_vote,
        f"WITH v AS (SELECT qid, label, count(*) AS votes FROM ({_ranked_sql('cosine', 10)}) JOIN embeddings USING (vec_id) GROUP BY ALL), r AS (SELECT *, "
        f"row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS r FROM v) SELECT qid, label, votes FROM r WHERE r = 1"),
    "consecutive_cosine": (consecutive_cosine, CONSECUTIVE_SQL),
    "l2_normalize": (l2_normalize,
        f"WITH v AS (SELECT vec_id, {_DBL.format('embeddings')} AS x FROM embeddings), n AS (SELECT vec_id, list_transform(x, "
        f"lambda a: a / sqrt(list_dot_product(x, x))) AS v FROM v) SELECT vec_id, round(v[1], 6) AS first, round(list_sum(v), 5) AS total FROM n"),
    "fitted_vectors": (fitted_vectors,
        f"WITH v AS (SELECT vec_id, list_slice({_DBL.format('embeddings')}, 1, 16) AS x FROM embeddings) SELECT vec_id, round(x[4] / sqrt(list_dot_product(x, "
        f"x)), 6) AS short_4, CAST(80 AS INTEGER) AS long_size FROM v"),
    "label_similarity": (label_similarity,
        f"SELECT e.label, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS greatest FROM ({_ranked_sql('cosine', 10)}) r "
        f"JOIN embeddings e ON e.vec_id = qid WHERE r.vec_id <> qid GROUP BY e.label"),
    "tfidf_char_pairs": (tfidf_char_pairs,
        f"{_CHAR_GRAMS}{_WEIGHTS} SELECT a.id AS qid, b.id AS doc_id, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b USING (term) WHERE a.id % 20 = 0 "
        f"GROUP BY ALL"),
    "tfidf_word_signals": (tfidf_word_signals, f"{_SIGNALS} SELECT qid, round(max_score, 6) AS max_score, round(avg_topk, 6) AS avg_topk, num_docs, context_len FROM o"),
    "route_decision": (route_decision, f"{_SIGNALS} SELECT qid, CASE WHEN max_score >= 0.30 OR avg_topk >= 0.12 THEN 'kb' ELSE 'small_model' END AS target FROM o"),
    "kb_best_match": (kb_best_match, None),
}

# the dialects' own class of white space is ASCII alone
QUERIES = {name: (query, sql and sql.replace(r"\s", WS)) for name, (query, sql) in QUERIES.items()}
