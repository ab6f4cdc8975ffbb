"""Queries over requests, chats, labels and registries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cache, context, dedupe, guard, maxscore, metrics, registry, tfidf
from ..sources.tables import FAQ, candidates_json, exposition, exposition_json, latest, question_bank, scratch_path, table
from ..sources.vector_store import VectorStore
from ..streaming import stateful

#: A policy whose patterns occur in the generated texts.
POLICY = guard.Policy(input_patterns=(r"(?i)licensed under", r"token = ", r"\bthe the\b", *guard.INPUT_PATTERNS), output_patterns=(r"REDACTED_PHONE",
    r"(?i)all rights reserved", *guard.OUTPUT_PATTERNS), doc_roles={"doc_src0": ("en", "fr"), "doc_other": ("en",)})
ROUTES = {"doc_src0": ("of the", "en la")}


def _requests(s, d):
    return table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("role"))


def _gate(mode):
    return lambda s, d: _requests(s, d).select("doc_id", guard.check_input(F.col("text"), POLICY, mode).alias("g")).select("doc_id", "g.blocked",
        F.array_join("g.violations", "|").alias("violations"))


def _hits(patterns, stage, mode, text="text"):
    cases = [f"CASE WHEN regexp_matches({text}, '{p}') THEN '{stage}:{p}' END" for p in patterns]
    if mode == "enforce":
        return f"coalesce({', '.join(cases)}, '')"
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '|')"


def _gate_sql(mode):
    v = _hits(POLICY.input_patterns, "input", mode)
    return f"SELECT doc_id, v <> '' AND '{mode}' = 'enforce' AS blocked, v AS violations FROM (SELECT doc_id, {v} AS v FROM documents)"


def guard_output(s, d):
    r = _requests(s, d).select("doc_id", guard.check_output(F.col("text"), POLICY, "report").alias("g"))
    return r.select("doc_id", "g.blocked", F.array_join("g.violations", "|").alias("violations"))


def acl_enforce(s, d):
    """Whether each document's language may see the two documents, in enforce and report mode."""
    docs = F.array(F.lit("doc_src0"), F.lit("doc_other"), F.lit("doc_unknown"))
    r = _requests(s, d).select("doc_id", guard.enforce_acl(F.col("role"), docs, POLICY, "enforce").alias("e"), guard.enforce_acl(F.col("role"), docs, POLICY, "report").alias("r"))
    return r.select("doc_id", "e.allowed", F.array_join("e.violations", "|").alias("first"), F.array_join("r.violations", "|").alias("every"))


def acl_join(s, d):
    """Requests that no grant covers, with grants as a table."""
    grants = s.createDataFrame([("src0", "en"), ("src0", "fr"), ("src1", "en"), ("src2", "de")], "doc_id string, role string")
    requests = table(s, d, "documents").select(F.col("doc_id").alias("req_id"), F.col("source").alias("doc_id"), F.col("lang").alias("role"))
    return guard.acl_violations(requests, grants).select("req_id", "doc_id", "role")


def guard_pipeline(s, d):
    g = guard.guarded(_requests(s, d), F.concat(F.lit("Answer: "), F.col("text")), POLICY, "enforce", ROUTES, "doc_other")
    return g.select("doc_id", "status", "reason", "n_redacted", F.length("answer").alias("answer_chars"))


def _pipeline_sql():
    from .text_queries import _sanitized

    kinds = X.EMAIL, X.LOCAL_PHONE, X.PHONE
    first = _hits(POLICY.input_patterns, "input", "enforce", "clean")
    out = " OR ".join(f"regexp_matches(p, '{x}')" for x in POLICY.output_patterns)
    return f"""
WITH a AS (SELECT doc_id, lang, 'Answer: ' || text AS t, {_sanitized('text')} AS clean FROM documents),
b AS (SELECT *, regexp_replace(t, '{kinds[0]}', '{X.EMAIL_MARK}', 'g') AS e FROM a),
c AS (SELECT *, regexp_replace(e, '{kinds[1]}', '{X.PHONE_MARK}', 'g') AS l FROM b),
f AS (SELECT *, regexp_replace(l, '{kinds[2]}', '{X.PHONE_MARK}', 'g') AS p0 FROM c),
g AS (SELECT *, regexp_replace(p0, '{X.API_KEY}', '{X.KEY_MARK}', 'g') AS p, len(regexp_extract_all(t, '{kinds[0]}')) + len(regexp_extract_all(e, '{kinds[1]}')) + len(regexp_extract_all(l, '{kinds[2]}')) + len(regexp_extract_all(p0, '{X.API_KEY}')) AS n FROM f),
h AS (SELECT *, CASE WHEN contains(lower(clean), 'of the') OR contains(lower(clean), 'en la') THEN 'doc_src0' ELSE 'doc_other' END AS doc FROM g),
k AS (SELECT *, CASE WHEN ({first}) <> '' THEN 'input' WHEN NOT (lang = 'en' OR (doc = 'doc_src0' AND lang = 'fr')) THEN 'acl' WHEN {out} THEN 'output' END AS reason FROM h)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'blocked' END AS status, reason, CAST(CASE WHEN reason IS NULL OR reason = 'output' THEN n ELSE 0 END AS INTEGER) AS n_redacted, CAST(CASE WHEN reason IS NULL THEN length(p) END AS INTEGER) AS answer_chars FROM k
"""


def _events(s, d):
    return table(s, d, "events")


def latency_histogram(s, d):
    return metrics.histogram(_events(s, d), ["event_type"], "value", (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)).select("event_type",
        F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("int").cast("string")).alias("le"), "n")


_EDGES = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)
_BUCKETS = " UNION ALL ".join([f"SELECT event_type, {e} AS le, count(*) FILTER (value <= {e}) AS n FROM events GROUP BY event_type" for e in _EDGES] + ["SELECT event_type, 'infinity'::DOUBLE AS le, count(value) AS n FROM events GROUP BY event_type"])


def latency_p95_bucket(s, d):
    return metrics.bucket_quantile(metrics.histogram(_events(s, d), ["event_type"], "value", _EDGES), ["event_type"], 0.95).select("event_type", F.round("value", 6).alias("p95"))


def latency_p95_exact(s, d):
    return _events(s, d).groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


def cost_rate(s, d):
    return metrics.rate(_events(s, d), "ts", "value", 60).select("start", F.round("rate", 6).alias("rate"))


def cost_by_model(s, d):
    """Cost of every chat turn, its text the completion, by a model dealt out by role."""
    c = table(s, d, "conversations").withColumn("model", F.when(F.col("role") == "user", "gpt-4o-mini").when(F.col("role") == "assistant", "gpt-4o").otherwise("other"))
    n = X.tokens_by_length("text")
    cost = metrics.model_cost(F.col("model"), n, n)
    return c.groupBy("model").agg(F.sum(n).alias("tokens"), F.round(F.sum(cost), 9).alias("cost"), F.round(F.sum(metrics.chat_cost(n, n)), 6).alias("flat_cost"))


def cache_hits(s, d):
    """Chat questions already asked before, by conversation order, without expiry."""
    q = table(s, d, "conversations").where("role = 'user'").withColumn("key", F.sha2("text", 256))
    asked = q.groupBy("key").agg(F.count("*").alias("times"))  # every time but the first is a hit; nothing of a key is sorted
    kinds = asked.agg(F.count("*").alias("misses"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("hits"))
    both = F.array(F.struct(F.lit(False).alias("hit"), F.col("misses").alias("n")), F.struct(F.lit(True).alias("hit"), F.col("hits").alias("n")))
    return kinds.select(F.explode(both).alias("k")).select("k.*").where("n > 0")


def rate_limit(s, d):
    """Each event of a user with whether a limiter of 10 a day admits it."""
    e = _events(s, d).select("event_id", F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return stateful.limit_batch(e, 10, 86_400_000_000).select("event_id", "admitted")


def turn_islands(s, d):
    """Runs of one role within a conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int"))
    return c.select("conv_id", "turn", "role", F.sum("new").over(w).alias("island"))


def chatml_pairs(s, d):
    """Questions and the answers that follow them as chat texts, and the parts read back."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' and next = 'assistant'")
    t = c.select("conv_id", "turn", X.chatml("text", "answer").alias("chat"))
    return t.select("conv_id", "turn", "chat", X.chatml_parts("chat")["answer"].alias("answer"))


def sft_messages(s, d):
    """Each conversation as one JSON list of messages."""
    m = F.struct("turn", "role", "text")
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return c.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


def prompt_render(s, d):
    t = F.lit("[{{ lang }}] {{text}} {{ missing }}|")
    return table(s, d, "documents").select("doc_id", X.render(t, {"lang": F.col("lang"), "text": F.col("text")}).alias("prompt"))


def contexts(s, d):
    """The texts of each conversation's assistant, joined in order."""
    return context.joined(table(s, d, "conversations").where("role = 'assistant'"), ["conv_id"], "turn")


def map_reduce(s, d):
    return context.map_reduce(table(s, d, "documents").select("doc_id", "text"), context.first_sentence)


def _answers(s, d):
    return table(s, d, "labels").withColumn("a", F.when(F.col("quality") == 1, "OK").otherwise("Hallucination")).withColumn("b",
        F.when(F.col("toxic") == 0, "OK").otherwise("Hallucination"))


def judge_ensemble(s, d):
    v = _answers(s, d).select("doc_id", F.explode(F.array("a", "b")).alias("label"))
    return metrics.ensemble(v, "doc_id", "label")


def confusion_counts(s, d):
    return metrics.confusion(_answers(s, d), "a", "b")


def quality_bins(s, d):
    return metrics.score_bins(_events(s, d), "value")


def source_distribution(s, d):
    return metrics.shares(table(s, d, "documents"), "source").select("source", "n", F.round("pct", 6).alias("pct"))


def topic_errors(s, d):
    """Labelled texts by the first topic that they match, with the share of bad ones."""
    t = metrics.first_match(F.col("text"), {"licence": "(?i)licen[sc]e", "table": r"\|", "markup": r"[#*%&]{3}"}, "other")
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy(t.alias("topic")).agg(F.count("*").alias("n"),
        F.round(F.avg(1 - F.col("quality")), 6).alias("error_rate"))


def _turns(s, d):
    """Whole questions of the chats and the whole answers that follow them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return c.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), F.col("answer").alias("c"))


_TURNS = "(SELECT conv_id, turn, text AS q, a AS c FROM (SELECT *, lead(text) OVER w AS a, lead(role) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND n = 'assistant')"


def answer_sources(s, d):
    """Answers by where they would come from: a rule that overrides them, a text of the knowledge base that they are like, or the model.

    The likeness, in percent, is that of character n-grams, to the best of the benchmark's items.
    """
    kb, turns = table(s, d, "benchmark"), _turns(s, d)
    counts = tfidf.term_counts(kb, "item_id", tfidf.char_grams("text"))
    idf = tfidf.fit(counts, kb.count())
    weights = tfidf.weigh(counts, idf).withColumnRenamed("id", "doc_id")
    likeness = tfidf.best_likeness(idf, weights)
    if likeness:
        scored = turns.withColumn("score", F.round(likeness("c"), 6))
    else:  # a base that tasks can't hold is searched by its lists
        turns = turns.withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
        asked = tfidf.weigh(tfidf.term_counts(turns, "qid", tfidf.char_grams("c")), idf).withColumnRenamed("id", "qid")
        scored = turns.join(maxscore.sparse_topk(asked, weights, 1, digits=6).select("qid", "score"), "qid", "left")
    best = F.coalesce(F.col("score") * 100, F.lit(0.0))
    src = metrics.answer_source(F.col("q"), F.col("c"), best, {"License": "(?i)license", "the": "(?i)the"}, _KB_MATCH)
    return scored.groupBy(src.alias("source_kind")).agg(F.count("*").alias("n"))


_KB_MATCH = 50.0
_GRAMS = "unnest(flatten([list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))])) AS term"
_SOURCES = f"""
WITH u AS {_TURNS}, kt AS (SELECT item_id AS id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM benchmark),
ut AS (SELECT conv_id, turn, regexp_replace(lower(c), '\\s+', ' ', 'g') AS t FROM u),
kc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, {_GRAMS} FROM kt) GROUP BY ALL),
i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM kt)) / (1 + count(*))) + 1 AS idf FROM kc GROUP BY term),
kw AS (SELECT id, term, tf * idf AS w FROM kc JOIN i USING (term)), kl AS (SELECT id, sqrt(sum(w * w)) AS l FROM kw GROUP BY id),
uw AS (SELECT conv_id, turn, term, count(*) * any_value(idf) AS w FROM (SELECT conv_id, turn, {_GRAMS} FROM ut) JOIN i USING (term) GROUP BY ALL),
ul AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS l FROM uw GROUP BY ALL),
p AS (SELECT conv_id, turn, id, sum(uw.w * kw.w) AS dot FROM uw JOIN kw USING (term) GROUP BY ALL),
b AS (SELECT conv_id, turn, max(round(dot / ul.l / kl.l, 6)) * 100 AS best FROM p JOIN ul USING (conv_id, turn) JOIN kl USING (id) GROUP BY ALL)
SELECT CASE WHEN (regexp_matches(q, '(?i)license') AND NOT contains(c, 'License')) OR (regexp_matches(q, '(?i)the') AND NOT contains(c, 'the')) THEN 'RULE_OVERRIDE'
    WHEN coalesce(best, 0) >= {_KB_MATCH} THEN 'KB_MATCH' ELSE 'MODEL_GENERATED' END AS source_kind, count(*) AS n FROM u LEFT JOIN b USING (conv_id, turn) GROUP BY 1
"""


def questions(s, d):
    rules = {"licen[sc]e": ["Which licence is it?", "May it be shared?"], r"\|": ["What is in the table?"]}
    return metrics.questions(table(s, d, "documents").select("doc_id", "text"), X.focus("text"), rules).select("doc_id", "question")


def _actions(s, d):
    """An action log dealt out from the orders: 50 models, 7 versions each, all kinds of steps."""
    o = table(s, d, "orders")
    kind = F.col("o_orderkey") % 7
    action = F.when(kind == 0, "create_model").when(kind <= 2, "create_version").otherwise("transition")
    stage = F.element_at(F.array(*map(F.lit, ("staging", "Production", "Archived", "nowhere"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("seq"), action.alias("action"), F.concat(F.lit("m"),
        (F.col("o_custkey") % 50).cast("string")).alias("model"), F.concat(F.lit("v"), (F.col("o_custkey") % 350).cast("string")).alias("version"),
        stage.alias("to_stage"), F.lit("ci").alias("actor"), (F.col("o_orderkey") % 3 == 0).alias("rollback"))


def change_detect(s, d):
    """Orders whose status differs from the customer's order before."""
    o = dedupe.changes(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return o.groupBy("o_custkey").agg(F.count_if("changed").alias("n_changed"))


def version_diff(s, d):
    o = table(s, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return dedupe.version_diff(old, new, "o_orderkey", "o_orderstatus").groupBy("change").agg(F.count("*").alias("n"))


def version_compare(s, d):
    v = table(s, d, "part").select("p_partkey", F.concat_ws(".", F.col("p_partkey") % 12, "p_size").alias("a"), F.concat_ws(".", "p_size", F.col("p_partkey") % 9).alias("b"))
    return v.select("p_partkey", (dedupe.version_parts("a") > dedupe.version_parts("b")).alias("newer"))


def latest_events(s, d):
    """The last event of each user and type: an upsert by key."""
    return latest(_events(s, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def exposition_lines(s, d):
    return exposition(metrics.counters(_events(s, d), ["event_type"]), "requests_total", ["event_type"], "n")


def candidate_rows(s, d):
    """The three first-priced parts of each brand as a candidate list."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(s, d, "part").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("p_brand").alias("query"), "rank",
        F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("retriever_score"))
    return candidates_json(p).select("query", F.array_join(F.transform("candidates", lambda c: c["idx"].cast("string")), ",").alias("ids"))


def windowed(slide):
    def run(s, d):
        e = _events(s, d).withColumn("t", F.col("ts").cast("timestamp"))
        w = F.window("t", "1 hour", slide)
        return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"),
            4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")

    return run


def session_counts(s, d):
    """Sessions of each user, 30 minutes without an event apart."""
    e = _events(s, d).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id",
        F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def revenue_rollup(s, d):
    l, o, c, n, r = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n,
        F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    v = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return j.withColumn("v", v).rollup("r_name", "n_name").agg(F.sum("v").cast("double").alias("revenue"), F.count("*").alias("n"))


def semi_anti(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    with_orders = c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n_with"))
    without = c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n_without"))
    return with_orders.join(without, "c_mktsegment", "full_outer").select("c_mktsegment", F.coalesce("n_with", F.lit(0)).alias("n_with"),
        F.coalesce("n_without", F.lit(0)).alias("n_without"))


def _cascade(s, d):
    """Every vector whose id is divisible by 20 asks; labels under 3 are in the exact cache, odd vectors in the semantic one."""
    e = table(s, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.concat(F.lit("label "),
        F.col("label").cast("string")).alias("question"), F.col("embedding").alias("v"))
    exact = s.createDataFrame([(f"label {i}", f"exact {i}") for i in range(3)], "question string, answer string").select(F.sha2("question", 256).alias("key"), "answer")
    semantic = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), F.concat(F.lit("near "), F.col("label").cast("string")).alias("a"), F.col("embedding").alias("v"))
    return cache.cascade(asked, exact, semantic, F.lit("generated"), 0.3)


def cache_cascade(s, d):
    return _cascade(s, d).select("qid", "answer", "source")


def cache_summary(s, d):
    return cache.summary(_cascade(s, d)).withColumn("hit_rate", F.round("hit_rate", 6))


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_CASCADE = f"""WITH n AS (SELECT q.vec_id AS qid, q.label, arg_max(b.label, {_DOT}) AS near, max({_DOT}) AS score FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0 AND b.vec_id % 2 = 1 GROUP BY ALL),
c AS (SELECT qid, CASE WHEN label < 3 THEN 'exact ' || label WHEN score >= 0.3 THEN 'near ' || near ELSE 'generated' END AS answer, CASE WHEN label < 3 THEN 'prompt_cache' WHEN score >= 0.3 THEN 'semantic_cache' ELSE 'llm' END AS source FROM n)"""


def semantic_insert(s, d):
    """The odd vectors put behind the even ones in a semantic cache."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("q").alias("q"), F.col("label").cast("string").alias("a"), F.col("embedding").alias("v"))
    return cache.insert_vectors(e.where("id % 2 = 0"), e.where("id % 2 = 1").withColumnRenamed("id", "o"), "o").select("id", "a")


def answer_by_route(s, d):
    rows = _turns(s, d).select("conv_id", "turn", F.col("q").alias("query"), F.col("c").alias("context"),
        ((F.col("conv_id") % 10) / 10 - 0.2).alias("max_score"), F.when(F.col("conv_id") % 3 == 0, "kb").otherwise("small_model").alias("target"))
    return cache.answer_by_route(rows, 0.5).select("conv_id", "turn", "answer", "tokens", F.round("cost", 9).alias("cost"))


def _words_sql(x):
    return rf"(len(list_filter(string_split_regex(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: regexp_matches(w, '[\x00-\x7F]'))) + len(regexp_extract_all({x}, '[一-鿿]')))"


_BY_ROUTE = f"""WITH r AS (SELECT *, conv_id % 10 > 2 AS hit, conv_id % 3 = 0 AS kb FROM {_TURNS}),
a AS (SELECT *, CASE WHEN hit THEN '{cache.FOUND}' || c ELSE '{cache.NO_HIT}' END AS s FROM r), t AS (SELECT *, CAST({_words_sql('q')} + {_words_sql('s')} AS INTEGER) AS n FROM a)
SELECT conv_id, turn, CASE WHEN kb THEN c ELSE s END AS answer, CASE WHEN kb THEN 0 ELSE n END AS tokens, CASE WHEN kb THEN 0 ELSE round(n / 1000 * 0.5e0, 9) END::DOUBLE AS cost FROM t"""


def chain_route(s, d):
    kind = cache.chain_route(F.col("text"), ("under the", "en la"))
    return table(s, d, "documents").groupBy(kind.alias("chain")).agg(F.count("*").alias("n"))


def _replayed(s, d):
    return registry.replay(_actions(s, d))


_LOG = """WITH l AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'create_model' WHEN o_orderkey % 7 <= 2 THEN 'create_version' ELSE 'transition' END AS action, 'm' || o_custkey % 50 AS model, 'v' || o_custkey % 350 AS version, ['staging', 'Production', 'Archived', 'nowhere'][o_orderkey % 4 + 1] AS to_stage FROM orders),
g AS (SELECT model, list({'seq': seq, 'action': action, 'version': version, 'to_stage': to_stage} ORDER BY seq) AS l FROM l GROUP BY model),
f AS (SELECT model, list_reduce(list_prepend({'known': false, 'st': MAP {}::MAP(VARCHAR, VARCHAR), 'out': []::STRUCT(seq BIGINT, action VARCHAR, version VARCHAR, to_stage VARCHAR, status VARCHAR, from_stage VARCHAR, stage VARCHAR)[], 'a': NULL::STRUCT(seq BIGINT, action VARCHAR, version VARCHAR, to_stage VARCHAR)},
  list_transform(l, lambda a: {'known': false, 'st': MAP {}::MAP(VARCHAR, VARCHAR), 'out': []::STRUCT(seq BIGINT, action VARCHAR, version VARCHAR, to_stage VARCHAR, status VARCHAR, from_stage VARCHAR, stage VARCHAR)[], 'a': a})),
  lambda r, x: STEP) AS r FROM g),
o AS (SELECT model, unnest(r.out) AS o FROM f), replayed AS (SELECT o.seq, o.action, model, o.version, o.to_stage, 'ci' AS actor, o.seq % 3 = 0 AS rollback, o.status, o.from_stage, o.stage FROM o)"""
_BEFORE = "r.st[x.a.version]"
_TO = "CASE x.a.to_stage WHEN 'staging' THEN 'Staging' WHEN 'nowhere' THEN NULL ELSE x.a.to_stage END"
_LEGAL = f"coalesce(list_contains({[f'{a}>{b}' for a, b in registry.ALLOWED]}, {_BEFORE} || '>' || {_TO}), false)"
_STATUS = f"CASE x.a.action WHEN 'create_model' THEN 'ok' WHEN 'create_version' THEN CASE WHEN NOT r.known THEN 'not_found' WHEN {_BEFORE} IS NOT NULL THEN 'conflict' ELSE 'ok' END ELSE CASE WHEN {_BEFORE} IS NULL THEN 'not_found' WHEN NOT {_LEGAL} THEN 'illegal' ELSE 'ok' END END"
_AFTER = f"CASE x.a.action WHEN 'create_model' THEN NULL WHEN 'create_version' THEN CASE WHEN NOT r.known THEN NULL ELSE coalesce({_BEFORE}, 'None') END ELSE CASE WHEN {_BEFORE} IS NULL THEN NULL WHEN {_LEGAL} THEN {_TO} ELSE {_BEFORE} END END"
_DEMOTED = f"CASE WHEN x.a.action = 'transition' AND {_LEGAL} AND {_TO} = 'Production' THEN map_from_entries(list_transform(map_entries(r.st), lambda e: {{'key': e.key, 'value': CASE WHEN e.value = 'Production' THEN 'Archived' ELSE e.value END}})) ELSE r.st END"
_STEP = f"{{'known': r.known OR x.a.action = 'create_model', 'st': CASE WHEN ({_STATUS}) = 'ok' AND x.a.action <> 'create_model' THEN map_concat({_DEMOTED}, MAP {{x.a.version: {_AFTER}}}) ELSE r.st END, 'out': list_append(r.out, {{'seq': x.a.seq, 'action': x.a.action, 'version': x.a.version, 'to_stage': x.a.to_stage, 'status': {_STATUS}, 'from_stage': {_BEFORE}, 'stage': {_AFTER}}}), 'a': x.a}}"
_LOG = _LOG.replace("STEP", _STEP)
#: A limiter as a fold: the times admitted within the window, and what was decided.
_LIMITED = """WITH g AS (SELECT user_id, list({'id': event_id, 't': epoch_us(ts)} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT list_reduce(list_prepend({'log': []::BIGINT[], 'out': []::STRUCT(event_id BIGINT, admitted BOOLEAN)[], 'x': NULL::STRUCT(id BIGINT, t BIGINT)}, list_transform(l, lambda e: {'log': []::BIGINT[], 'out': []::STRUCT(event_id BIGINT, admitted BOOLEAN)[], 'x': e})),
  lambda a, b: {'log': CASE WHEN len(list_filter(a.log, lambda t: b.x.t - t <= 86400000000)) < 10 THEN list_append(list_filter(a.log, lambda t: b.x.t - t <= 86400000000), b.x.t) ELSE list_filter(a.log, lambda t: b.x.t - t <= 86400000000) END,
  'out': list_append(a.out, {'event_id': b.x.id, 'admitted': len(list_filter(a.log, lambda t: b.x.t - t <= 86400000000)) < 10}), 'x': b.x}) AS r FROM g)
SELECT o.event_id, o.admitted FROM (SELECT unnest(r.out) AS o FROM f)"""
#: A flag for each event of a key that depends on the last event that had it.
_FOLDED = """WITH g AS (SELECT list({{'id': event_id, 't': epoch_us(ts)}} ORDER BY {order}) AS l FROM events GROUP BY {key}),
f AS (SELECT list_reduce(list_prepend({{'last': {init}::BIGINT, 'out': []::STRUCT(event_id BIGINT, {flag} BOOLEAN)[], 'x': NULL::STRUCT(id BIGINT, t BIGINT)}}, list_transform(l, lambda e: {{'last': NULL::BIGINT, 'out': []::STRUCT(event_id BIGINT, {flag} BOOLEAN)[], 'x': e}})),
  lambda a, b: {{'last': CASE WHEN {fire} THEN b.x.t ELSE a.last END, 'out': list_append(a.out, {{'event_id': b.x.id, '{flag}': {fire}}}), 'x': b.x}}) AS r FROM g)
SELECT o.event_id, o.{flag} FROM (SELECT unnest(r.out) AS o FROM f)"""
_FIRST = r"regexp_extract({0}, '^\s*([^.!?。！？]*[.!?。！？]?)', 1)"
_SUMMARY = rf"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, text, list_transform(range(0, CAST(1 + ceil(greatest(len(w) - 100, 0) / 80) AS BIGINT)), lambda i: array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ')) AS c FROM w)
SELECT doc_id, CASE WHEN length(text) < 60 THEN text ELSE {_FIRST.format("array_to_string(list_transform(c, lambda x: " + _FIRST.format("x") + "), ' ')")} END AS summary FROM c"""


def _questions_sql():
    from .text_queries import _STRIP

    forms = ", ".join(f"'{a}' || f || '{b}'" for a, b in (form.split("{}") for form in metrics.QUESTION_FORMS))
    focus = rf"left(regexp_replace({_STRIP.format('text')}, '[。；；，,.;]\s*$', ''), 20)"
    return rf"""WITH a AS (SELECT doc_id, text, {focus} AS f FROM documents),
q AS (SELECT doc_id, unnest(list_concat(CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN ['Which licence is it?', 'May it be shared?'] ELSE [] END, CASE WHEN regexp_matches(text, '\|') THEN ['What is in the table?'] ELSE [] END, [{forms}])) AS q FROM a),
c AS (SELECT DISTINCT doc_id, replace(regexp_replace(q, '^[？? ]+|[？? ]+$', '', 'g'), '  ', ' ') AS question FROM q)
SELECT doc_id, question FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('q' || question), question) AS r FROM c WHERE length(question) >= 4) WHERE r <= 2"""


def registry_tables(s, d):
    """Versions beside their models, from tables with a foreign key: nations of their regions."""
    models = table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("team").alias("owner"))
    versions = table(s, d, "nation").select(F.col("n_regionkey").alias("model_id"), F.col("n_name").alias("version"),
        F.when(F.col("n_nationkey") % 2 == 0, "Production").otherwise("Staging").alias("stage"))
    return registry.models_with_versions(models, versions)


def at_stage(s, d):
    v = table(s, d, "documents").select("doc_id", F.col("lang").alias("role"), F.col("source").alias("stage"))
    return registry.at_stage(v, "src0", "en").select("doc_id")


_PROMPTS = [("faq", "v1", "A {{ q }}"), ("faq", "v2", "B {{ q }}"), ("faq", "v10", "C {{ q }}"), ("summary", "v2", "S {{ q }}")]


def prompt_resolve(s, d):
    """Each chat turn's prompt: the version in its header, its body, or the default."""
    prompts = s.createDataFrame(_PROMPTS, "name string, version string, template string")
    c = table(s, d, "conversations").select("conv_id", "turn", F.lit("faq").alias("name"), F.when(F.col("turn") % 3 == 0,
        "v1").alias("header_version"), F.when(F.col("conv_id") % 2 == 0, "v10").alias("body_version"))
    return registry.resolve_prompts(c, prompts).select("conv_id", "turn", "prompt_id", "template")


def prompt_versions(s, d):
    return registry.prompt_versions(s.createDataFrame(_PROMPTS, "name string, version string, template string")).select(F.array_join("versions", ",").alias("versions"))


def kb_manifest(s, d):
    docs = table(s, d, "documents")
    return registry.kb_version(docs, 3, 384, "hash").unionByName(registry.kb_version(docs, 3, 384, "hash", 1700000000))


def prompts(s, d):
    """A question to each conversation over the assistant's texts, in order."""
    c = contexts(s, d)
    return c.select("conv_id", context.prompt("Answer from the context.", F.col("context"), F.lit("What was said?")).alias("prompt"))


def missing_templates(s, d):
    """Languages for which there is no prompt."""
    have = s.createDataFrame([("en",), ("de",)], "lang string")
    return table(s, d, "documents").select("lang").distinct().join(have, "lang", "left_anti")


def debounce(s, d):
    e = _events(s, d).select("event_id", F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return stateful.debounce_batch(e, 7_200_000_000).select("event_id", "fired")


def cache_ttl(s, d):
    """Each event of a user, by type, as a request to a cache whose entries live a day from the miss."""
    e = _events(s, d).select("event_id", F.concat_ws("|", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return stateful.cache_batch(e, 86_400_000_000).select("event_id", "hit")


def cache_live(s, d):
    """Entries put at the events' times that are live at one moment, and how many there are."""
    e = _events(s, d).select(F.col("event_id").cast("string").alias("question"), "ts")
    stored = cache.put(e, F.col("ts"), 86_400)
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    live = cache.live(stored.where(F.col("ts") <= now), now)
    return cache.size(live).select("size").unionByName(cache.size(cache.cleared(live)))


def request_outcomes(s, d):
    e = _events(s, d).select(F.when(F.col("event_type") == "view", "/metrics").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("value") > 50, 500).otherwise(200).alias("status"))
    return metrics.request_outcomes(e).select("event_type", "n", "errors", F.round("error_rate", 6).alias("error_rate"))


def p95_by_minute(s, d):
    """The 95th percentile, by buckets, of each minute's requests."""
    e = _events(s, d).withColumn("minute", F.date_trunc("minute", "ts"))
    return metrics.bucket_quantile(metrics.histogram(e, ["minute"], "value", _EDGES), ["minute"], 0.95).select("minute", F.round("value", 6).alias("p95"))


def exposition_forms(s, d):
    """Counters as JSON, histogram buckets as text, and labels that need escaping."""
    n = metrics.counters(_events(s, d), ["event_type"])
    odd = n.withColumn("event_type", F.concat(F.lit('a"b\\c\n'), "event_type"))
    h = latency_histogram(s, d)
    return exposition_json(n, "requests_total", ["event_type"], "n").unionByName(exposition(odd, "odd_total", ["event_type"],
        "n")).unionByName(exposition(h, "latency_bucket", ["event_type", "le"], "n"))


def change_gated(s, d):
    """Documents whose text isn't the one that an earlier run has seen."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"), "lang", "source")
    seen = docs.where("lang <> 'de'").withColumn("hash", F.when(F.col("source") == "src1", "old").otherwise(F.col("hash")))
    return dedupe.changed_files(docs, seen).select(F.col("path").alias("doc_id"))


def mtime_sensor(s, d):
    """Users whose last event is behind the cursor of their file."""
    files = _events(s, d).groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("mtime"))
    cursor = files.where("path % 2 = 0").select("path", F.when(F.col("path") % 4 == 0, F.col("mtime")).otherwise(F.col("mtime") - 1).alias("last"))
    return dedupe.fired_by_mtime(files, cursor)


def bank_questions(s, d):
    """Documents joined to a bank of questions by style; those without questions are left out."""
    styles = F.create_map(F.lit("plain"), F.array(F.lit("What is it?"), F.lit("Who says so?")), F.lit("short"), F.array(F.lit("What?")))
    bank = table(s, d, "documents").where("lang <> 'en'").select("doc_id", styles.alias("styles"))
    q = question_bank(bank)
    return table(s, d, "documents").select("doc_id", "lang").join(q, "doc_id")


def policy_table(s, d):
    """Requests checked by a policy that is kept as a table."""
    rules = s.createDataFrame([("input", 1, "(?i)license"), ("input", 0, r"\bthe\b"), ("output", 0, "x")], "stage string, ord int, pattern string")
    g = guard.check_input(F.col("text"), guard.policy_of(rules), "enforce")
    return table(s, d, "documents").select("doc_id", g.alias("g")).select("doc_id", "g.blocked", F.array_join("g.violations", "|").alias("violations"))


#: Programs of a chain: a summary of the text, then questions about the summary with their answers as JSON.
_ABOUT = "What is it about?"
_PROGRAMS = [("summary", "Summarise:\n{{ context }}", {"context": "text"}), ("faq", "Context: {{ context }}\nQuestion: {{ question }}",
    {"context": "summary", "question": "question"})]


def _stand_in(name, prompt):
    """Answers by rule: the first sentence of what is to be summarised; what follows Context as the answer to the question, fenced."""
    if name == "summary":
        return context.first_sentence(F.substr(prompt, F.lit(len("Summarise:\n") + 1)))
    said = F.regexp_extract(prompt, r"(?s)^Context: (.*)\nQuestion: (.*)$", 1)
    asked = F.regexp_extract(prompt, r"(?s)^Context: (.*)\nQuestion: (.*)$", 2)
    return F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(asked.alias("q"), said.alias("a"))).alias("faqs"))), F.lit("\n```"))


def chained_programs(s, d):
    """Every text summarised, asked about its summary, and the answer's JSON read back as question and answer."""
    docs = table(s, d, "documents").select("doc_id", "text").withColumn("question", F.lit(_ABOUT))
    said = context.chain(docs, _PROGRAMS, _stand_in).withColumn("json", X.extract_json(X.strip_fences("faq")))
    items = said.select("doc_id", F.explode(F.from_json("json", FAQ)["faqs"]).alias("faq"))
    return items.select("doc_id", F.concat(F.lit("Q: "), F.col("faq.q"), F.lit(" A: "), F.col("faq.a")).alias("text"))


def request_log(s, d):
    """Each event as a request that took its value in hundredths of a second, with its cost."""
    e = _events(s, d).withColumn("ended", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 12345).cast("long")))
    return metrics.request_log(e, "ts", "ended", F.col("value") / 7000).select("event_id", "latency_s", "cost_usd")


def vector_upserts(s, d):
    """(vec_id, version, label, first): embeddings put into a store, then some of them again with other metadata, some taken out, and all merged."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"),
        F.col("label").cast("string")).alias("metadata"))
    store = VectorStore(s, scratch_path(s, "vectors"))
    store.upsert(e, 1)
    again = e.where("id % 3 = 0").select("id", F.reverse("vector").alias("vector"), F.create_map(F.lit("label"), F.lit("changed")).alias("metadata"))
    store.upsert(again, 2)
    store.upsert(again, 2)  # the batch again, after a failure
    store.delete(e.where("id % 10 = 9"), 3)
    store.compact()
    return store.rows().select(F.col("id").alias("vec_id"), F.col("metadata")["label"].alias("label"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


QUERIES = {
    "registry_tables": (registry_tables,
        "SELECT r_name AS name, 'team' AS owner, n_name AS version, CASE WHEN n_nationkey % 2 = 0 THEN 'Production' ELSE 'Staging' END AS stage FROM nation "
        "JOIN region ON n_regionkey = r_regionkey"),
    "registry_at_stage": (at_stage, "SELECT doc_id FROM documents WHERE source = 'src0' AND lang = 'en'"),
    "prompt_resolve": (prompt_resolve,
        "WITH v AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'v1' WHEN conv_id % 2 = 0 THEN 'v10' ELSE 'v2' END AS v FROM conversations) "
        "SELECT conv_id, turn, 'faq:' || v AS prompt_id, CASE v WHEN 'v1' THEN 'A' WHEN 'v2' THEN 'B' ELSE 'C' END || ' {{ q }}' AS template FROM v"),
    "prompt_versions": (prompt_versions, "SELECT 'v1,v10,v2' AS versions"),
    "kb_manifest": (kb_manifest,
        "SELECT CAST(4 AS INTEGER) AS kb_version, v AS version, count(*) AS doc_count, CAST(384 AS INTEGER) AS dim, 'hash' AS model FROM documents, "
        "(VALUES ('4-kb'), ('4-kb+1700000000')) t(v) GROUP BY v"),
    "context_prompts": (prompts, "SELECT conv_id, 'Answer from the context.' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) "
        "ORDER BY turn) || chr(10) || chr(10) || 'Q: What was said?' || chr(10) || 'A:' AS prompt FROM conversations WHERE role = 'assistant' GROUP BY conv_id"),
    "missing_templates": (missing_templates, "SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')"),
    "debounce": (debounce, _FOLDED.format(key="user_id", init="NULL", fire="a.last IS NULL OR (b.x.t - a.last >= 7200000000 AND b.x.t <> a.last)",
        flag="fired", order="ts, event_id")),
    "cache_ttl": (cache_ttl, _FOLDED.format(key="user_id, event_type", init="NULL", fire="a.last IS NULL OR b.x.t - a.last >= 86400000000",
        flag="miss", order="ts, event_id").replace("o.miss FROM", "NOT o.miss AS hit FROM")),
    "cache_live": (cache_live, "SELECT count(*) AS size FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15' UNION ALL SELECT 0"),
    "request_outcomes": (request_outcomes,
        "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS errors, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS error_rate "
        "FROM events WHERE event_type <> 'view' GROUP BY event_type"),
    "latency_p95_by_minute": (p95_by_minute, "WITH b AS (" + _BUCKETS.replace("event_type",
        "date_trunc('minute', ts) AS minute").replace("GROUP BY date_trunc('minute', ts) AS minute",
        "GROUP BY 1") + "), w AS (SELECT *, max(n) OVER (PARTITION BY minute) AS total, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low "
        "FROM b WINDOW w AS (PARTITION BY minute ORDER BY le)) SELECT minute, round(CASE WHEN isinf(le) THEN low "
        "ELSE low + (le - low) * (0.95 * total - below) / (n - below) END, 6) AS p95 FROM w WHERE n >= 0.95 * total AND below < 0.95 * total"),
    "exposition_forms": (exposition_forms,
        f"""SELECT '{{"name":"requests_total","labels":{{"event_type":"' || event_type || '"}},"value":' || count(*) || '}}' AS line FROM events GROUP BY event_type UNION ALL SELECT 'odd_total{{event_type="a\\"b\\\\c\\n' || event_type || '"}} ' || count(*) FROM events GROUP BY event_type UNION ALL SELECT 'latency_bucket{{event_type="' || event_type || '",le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS INTEGER) AS VARCHAR) END || '"}} ' || n FROM ({_BUCKETS})"""),
    "change_gated": (change_gated, "SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src1'"),
    "mtime_sensor": (mtime_sensor, "SELECT user_id AS path, max(event_id) AS mtime, CAST(max(event_id) AS VARCHAR) AS run_key FROM events WHERE user_id % 4 <> 0 GROUP BY user_id"),
    "bank_questions": (bank_questions,
        "SELECT doc_id, lang, style, question FROM documents, (VALUES ('plain', 'What is it?'), ('plain', 'Who says so?'), ('short', 'What?')) t(style, "
        "question) WHERE lang <> 'en'"),
    "policy_table": (policy_table,
        r"SELECT doc_id, v <> '' AS blocked, v AS violations FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '\bthe\b') THEN 'input:\bthe\b' "
        r"WHEN regexp_matches(text, '(?i)license') THEN 'input:(?i)license' ELSE '' END AS v FROM documents)"),
    "chained_programs": (chained_programs, f"SELECT doc_id, 'Q: {_ABOUT} A: ' || " + _FIRST.format("coalesce(text, '')").replace(r"\s", X.WS) + " AS text FROM documents"),
    "request_log": (request_log, "SELECT event_id, round(floor(value * 12345) / 1000000, 3) AS latency_s, round(value / 7000, 6) AS cost_usd FROM events"),
    "vector_upserts": (vector_upserts,
        "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'changed' ELSE label::VARCHAR END AS label, round((CASE WHEN vec_id % 3 = 0 "
        "THEN embedding[len(embedding)] ELSE embedding[1] END)::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 10 <> 9"),
    "guard_input_enforce": (_gate("enforce"), _gate_sql("enforce")),
    "guard_input_report": (_gate("report"), _gate_sql("report")),
    "guard_output": (guard_output, f"SELECT doc_id, false AS blocked, {_hits(POLICY.output_patterns, 'output', 'report')} AS violations FROM documents"),
    "acl_enforce": (acl_enforce,
        "WITH v AS (SELECT doc_id, list_filter([CASE WHEN lang NOT IN ('en', 'fr') THEN 'acl_denied:doc_src0' END, CASE WHEN lang <> 'en' "
        "THEN 'acl_denied:doc_other' END, 'acl_denied:doc_unknown'], lambda x: x IS NOT NULL) AS v FROM documents) SELECT doc_id, false AS allowed, "
        "v[1] AS first, array_to_string(v, '|') AS every FROM v"),
    "acl_join": (acl_join,
        "SELECT doc_id AS req_id, source AS doc_id, lang AS role FROM documents WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('src0', 'en'), ('src0', 'fr'), "
        "('src1', 'en'), ('src2', 'de')) g(a, b) WHERE a = source AND b = lang)"),
    "guard_pipeline": (guard_pipeline, _pipeline_sql()),
    "request_counters": (lambda s, d: metrics.counters(_events(s, d), ["event_type"], "value").select("event_type", "n", F.round("total",
        4).alias("total")), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"),
    "metrics_rollup": (lambda s, d: metrics.rollup(_events(s, d).withColumn("u", F.col("user_id") % 3), ["event_type", "u"],
        "value").select("event_type", "u", "n", F.round("total", 4).alias("total")),
        "SELECT event_type, user_id % 3 AS u, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, u)"),
    "latency_histogram": (latency_histogram, f"SELECT event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS INTEGER) AS VARCHAR) END AS le, n FROM ({_BUCKETS})"),
    "latency_p95_bucket": (latency_p95_bucket,
        f"WITH b AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low "
        f"FROM ({_BUCKETS}) WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(CASE WHEN isinf(le) THEN low "
        f"ELSE low + (le - low) * (0.95 * total - below) / (n - below) END, 6) AS p95 FROM b WHERE n >= 0.95 * total AND below < 0.95 * total"),
    "latency_p95_exact": (latency_p95_exact, "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"),
    "cost_rate_1m": (cost_rate, "SELECT date_trunc('minute', ts) AS start, round(sum(value) / 60, 6) AS rate FROM events GROUP BY 1"),
    "cost_by_model": (cost_by_model,
        "WITH c AS (SELECT CASE role WHEN 'user' THEN 'gpt-4o-mini' WHEN 'assistant' THEN 'gpt-4o' ELSE 'other' END AS model, CAST(greatest(1, "
        "floor(length(text) / 4)) AS INTEGER) AS n FROM conversations) SELECT model, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n * CASE model "
        "WHEN 'gpt-4o-mini' THEN 0.15e-6 + 0.60e-6 WHEN 'gpt-4o' THEN 2.5e-6 + 10e-6 ELSE 0e0 END), 9) AS cost, "
        "round(sum(round(n / 1000 * 0.003e0 + n / 1000 * 0.006e0, 6)), 6) AS flat_cost FROM c GROUP BY model"),
    "cache_exact_hits": (cache_hits,
        "SELECT r > 1 AS hit, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations "
        "WHERE role = 'user') GROUP BY 1"),
    "rate_limit": (rate_limit, _LIMITED),
    "turn_islands": (turn_islands,
        "SELECT conv_id, turn, role, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM (SELECT *, CASE WHEN role IS DISTINCT "
        "FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS n FROM conversations)"),
    "chatml_pairs": (chatml_pairs,
        r"WITH c AS (SELECT *, lead(text) OVER w AS a, lead(role) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
        r"SELECT conv_id, turn, "
        r"'<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>' AS chat, "
        r"regexp_replace(a, '^\s+|\s+$', '', 'g') AS answer FROM c WHERE role = 'user' AND n = 'assistant'"),
    "sft_messages": (sft_messages, "SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"),
    "context_concat": (contexts, "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE role = 'assistant' GROUP BY conv_id"),
    "map_reduce_summary": (map_reduce, _SUMMARY),
    "judge_ensemble": (judge_ensemble,
        "SELECT doc_id, quality = 1 AND toxic = 0 AS all_ok, quality = 1 OR toxic = 0 AS any_ok, CASE WHEN quality = 1 AND toxic = 0 THEN 'OK' "
        "WHEN quality = 0 AND toxic = 1 THEN 'Hallucination' ELSE 'REVIEW' END AS consensus FROM labels"),
    "confusion_counts": (confusion_counts,
        "SELECT CASE WHEN quality = 1 THEN 'OK → Hallucination' ELSE 'Hallucination → OK' END AS pair, count(*) AS n FROM labels WHERE quality = toxic "
        "GROUP BY 1"),
    "quality_bins": (quality_bins,
        "SELECT CASE WHEN value >= 85 THEN 'excellent' WHEN value >= 70 THEN 'good' WHEN value >= 50 THEN 'fair' ELSE 'poor' END AS bin, count(*) AS n "
        "FROM events GROUP BY 1"),
    "source_distribution": (source_distribution, "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM documents GROUP BY source"),
    "topic_errors": (topic_errors,
        r"SELECT CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' WHEN regexp_matches(text, '\|') THEN 'table' WHEN regexp_matches(text, "
        r"'[#*%&]{3}') THEN 'markup' ELSE 'other' END AS topic, count(*) AS n, round(avg(1 - quality), 6) AS error_rate FROM documents "
        r"JOIN labels USING (doc_id) GROUP BY 1"),
    "sft_questions": (questions, _questions_sql()),
    "registry_replay": (_replayed, f"{_LOG} SELECT * FROM replayed"),
    "registry_production": (lambda s, d: registry.production(_replayed(s, d)),
        f"{_LOG}, m AS (SELECT *, row_number() OVER (PARTITION BY model, version ORDER BY seq DESC) AS r FROM replayed WHERE status = 'ok' "
        f"AND stage IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS n FROM m WHERE r = 1 AND stage = 'Production') "
        f"SELECT model, version FROM p WHERE n = 1"),
    "registry_audit": (lambda s, d: registry.audit(_replayed(s, d)),
        f"{_LOG} SELECT seq, model, version, action, actor, from_stage, stage AS to_stage, CASE WHEN action = 'transition' "
        f"THEN '{{\"rollback_to\":' || rollback::VARCHAR || '}}' END AS detail FROM replayed WHERE status = 'ok' AND action IN ('create_version', 'transition')"),
    "change_detect": (change_detect, "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM p) AS n_changed FROM (SELECT *, "
        "lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) GROUP BY o_custkey"),
    "version_diff": (version_diff,
        "WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' "
        "ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0) SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL "
        "THEN 'removed' WHEN a.o_orderstatus = b.s THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey "
        "GROUP BY 1"),
    "version_compare": (version_compare, "SELECT p_partkey, [p_partkey % 12, p_size] > [p_size, p_partkey % 9] AS newer FROM part"),
    "latest_upsert": (latest_events, "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL"),
    "exposition": (exposition_lines, "SELECT 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type"),
    "candidates_json": (candidate_rows,
        "SELECT p_brand AS query, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY p_brand "
        "ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3 GROUP BY p_brand"),
    "tumbling_counts": (windowed("1 hour"), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "sliding_counts": (windowed("30 minutes"),
        "WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value "
        "FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"),
    "session_counts": (session_counts,
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n "
        "FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, "
        "min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"),
    "rollup_revenue": (revenue_rollup,
        "SELECT r_name, n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem "
        "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"),
    "semi_anti": (semi_anti,
        "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_with, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey "
        "FROM orders)) AS n_without FROM customer GROUP BY 1"),
    "cache_cascade": (cache_cascade, f"{_CASCADE} SELECT * FROM c"),
    "cache_summary": (cache_summary, f"{_CASCADE} SELECT count(*) AS requests, count(*) FILTER (source = 'prompt_cache') AS exact_hits, "
        f"count(*) FILTER (source = 'semantic_cache') AS semantic_hits, count(*) FILTER (source = 'llm') AS misses, "
        f"round(count(*) FILTER (source <> 'llm') / count(*), 6) AS hit_rate FROM c"),
    "semantic_cache_insert": (semantic_insert,
        "SELECT vec_id AS id, CAST(label AS VARCHAR) AS a FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT (SELECT max(vec_id) FROM embeddings "
        "WHERE vec_id % 2 = 0) + row_number() OVER (ORDER BY vec_id), CAST(label AS VARCHAR) FROM embeddings WHERE vec_id % 2 = 1"),
    "prompt_render": (prompt_render, "SELECT doc_id, '[' || lang || '] ' || text || ' |' AS prompt FROM documents"),
    "answer_sources": (answer_sources, _SOURCES),
    "answer_by_route": (answer_by_route, _BY_ROUTE),
    "chain_route": (chain_route,
        "SELECT CASE WHEN trim(text) = '' THEN 'summary' WHEN contains(lower(text), 'under the') OR contains(lower(text), 'en la') THEN 'pricing' "
        "ELSE 'faq' END AS chain, count(*) AS n FROM documents GROUP BY 1"),
}

# the dialects' own class of white space is ASCII alone
QUERIES = {name: (query, sql and sql.replace(r"\s", X.WS)) for name, (query, sql) in QUERIES.items()}
