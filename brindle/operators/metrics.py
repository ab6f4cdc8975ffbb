"""Counters, histograms, quantiles, rates, costs and evaluation figures over request and answer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket edges in seconds; prices a token by model; prices of a thousand tokens.
EDGES = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
PRICES = {
    "gpt-4o": (2.50e-6, 10.00e-6),
    "gpt-4o-mini": (0.15e-6, 0.60e-6),
    "gpt-4.1": (2.00e-6, 8.00e-6),
    "gpt-4.1-mini": (0.40e-6, 1.60e-6),
}
PROMPT_PER_1K, COMPLETION_PER_1K = 0.003, 0.006


def counters(rows: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    """Requests, and the sum of a value, for each combination of labels."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return rows.groupBy(*labels).agg(*aggs)


def rollup(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Counters with subtotals over each prefix of the labels."""
    return rows.rollup(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def histogram(rows: DataFrame, labels: list[str], value: str, edges=EDGES) -> DataFrame:
    """(labels, le, n): cumulative buckets, +Inf last, in one pass over the rows."""
    counted = rows.groupBy(*labels).agg(*[F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)], F.count(value).alias("all"))
    pairs = [F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n"))]
    return counted.select(*labels, F.explode(F.array(*pairs)).alias("b")).select(*labels, "b.le", "b.n")


def bucket_quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """(labels, value): the quantile read off cumulative buckets, linear inside a bucket; past the last edge, that edge."""
    w = Window.partitionBy(*labels).orderBy("le")
    whole = Window.partitionBy(*labels)
    rows = buckets.withColumn("total", F.max("n").over(whole)).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low",
        F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    hit = rows.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*labels, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("value"))


def rate(rows: DataFrame, ts: str, value: str, seconds: int = 60) -> DataFrame:
    """(start, rate): the sum of a value per second in each window."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return rows.groupBy(w.alias("w")).agg((F.sum(value) / seconds).alias("rate")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "rate")


def model_cost(model: Column, prompt: Column, completion: Column, prices=PRICES) -> Column:
    """Cost of a call by the price table; an unknown model costs nothing."""
    out = F.lit(0.0)
    for name, (p, c) in prices.items():
        out = F.when(model == name, prompt * p + completion * c).otherwise(out)
    return out


def chat_cost(prompt: Column, completion: Column) -> Column:
    return F.round(prompt / 1000 * PROMPT_PER_1K + completion / 1000 * COMPLETION_PER_1K, 6)


def request_log(rows: DataFrame, started: str, ended: str, cost: Column) -> DataFrame:
    """rows with latency_s, the seconds between two times to 3 places, and cost_usd to 6."""
    micros = F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))
    return rows.withColumn("latency_s", F.round(micros / 1_000_000, 3)).withColumn("cost_usd", F.round(cost, 6))


def score_bins(rows: DataFrame, score: str) -> DataFrame:
    """(bin, n) of similarities in percent: from 85, from 70, from 50, less."""
    b = F.when(F.col(score) >= 85, "excellent").when(F.col(score) >= 70, "good").when(F.col(score) >= 50, "fair").otherwise("poor")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, pct): counts and percent of all; the total is one number, joined to the groups."""
    groups = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n").alias("total"))
    return groups.join(F.broadcast(total), F.lit(True)).select(label, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def confusion(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """(pair, n) of "A → B" where they differ."""
    wrong = rows.where(F.col(expected) != F.col(got)).groupBy(expected, got).agg(F.count("*").alias("n"))
    return wrong.select(F.concat(F.col(expected), F.lit(" → "), F.col(got)).alias("pair"), "n")


def ensemble(verdicts: DataFrame, key: str, label: str, good: str = "OK") -> DataFrame:
    """(key, all_ok, any_ok, consensus) of several judges' labels; where they differ, REVIEW."""
    ok = F.col(label) == good
    consensus = F.when(F.min(label) == F.max(label), F.min(label)).otherwise("REVIEW")
    return verdicts.groupBy(key).agg(F.bool_and(ok).alias("all_ok"), F.bool_or(ok).alias("any_ok"), consensus.alias("consensus"))


def answer_source(question: Column, answer: Column, best: Column, topics: dict[str, str], threshold: float = 80.0) -> Column:
    """RULE_OVERRIDE where a topic's pattern is in the question and the topic isn't in the answer, KB_MATCH from the
    threshold on, else MODEL_GENERATED."""
    over = F.lit(False)
    for topic, pattern in topics.items():
        over = over | (question.rlike(pattern) & ~answer.contains(topic))
    return F.when(over, "RULE_OVERRIDE").when(best >= threshold, "KB_MATCH").otherwise("MODEL_GENERATED")


def first_match(text: Column, rules: dict[str, str], default: str) -> Column:
    """The name of the first pattern that matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def all_matches(rows: DataFrame, text: str, rules: dict[str, list[str]]) -> DataFrame:
    """rows with questions: those of every pattern that the text matches, in order, each once."""
    lists = [F.when(F.col(text).rlike(f"(?i){p}"), F.array(*map(F.lit, qs))).otherwise(F.array().cast("array<string>")) for p, qs in rules.items()]
    return rows.withColumn("questions", F.array_distinct(F.concat(*lists)))


#: Generic questions about a text, by its focus.
QUESTION_FORMS = ("想請問：{}？", "{}要怎麼做？", "公司關於{}的規定是什麼？", "可以提供{}的流程/做法嗎？", "遇到{}時我該怎麼處理？", "{}有哪些重點？")


def questions(rows: DataFrame, focus: Column, rules: dict[str, list[str]], text: str = "text", forms=QUESTION_FORMS, most: int = 2, seed: str = "q") -> DataFrame:
    """(…, question): questions of matching rules and generic ones, at least 4 characters, each once, ``most`` a row in an order fixed by the seed."""
    generic = F.array(*[F.concat(F.lit(f.split("{}")[0]), focus, F.lit(f.split("{}")[1])) for f in forms])
    both = all_matches(rows, text, rules).withColumn("questions", F.concat("questions", generic))
    cleaned = F.array_distinct(F.filter(F.transform("questions", lambda q: F.replace(F.regexp_replace(q, "^[？? ]+|[？? ]+$", ""), F.lit("  "),
        F.lit(" "))), lambda q: F.length(q) >= 4))
    shuffled = F.array_sort(F.transform(cleaned, lambda q: F.struct(F.md5(F.concat(F.lit(seed), q)).alias("k"), q.alias("q"))))
    return both.withColumn("question", F.explode(F.slice(F.transform(shuffled, lambda s: s["q"]), 1, most))).drop("questions")


def request_outcomes(rows: DataFrame, route: str = "event_type") -> DataFrame:
    """(route, n, errors, error_rate): requests by route; the metrics route isn't counted."""
    err = F.col("status") >= 500
    return rows.where(F.col(route) != "/metrics").groupBy(route).agg(F.count("*").alias("n"), F.count_if(err).alias("errors"), F.avg(err.cast("int")).alias("error_rate"))
