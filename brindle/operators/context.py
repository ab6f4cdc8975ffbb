"""Contexts and prompts from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import token_windows
from ..functions.text import render


def joined(rows: DataFrame, key: list[str], order: str, text: str = "text", sep: str = "\n\n", out: str = "context") -> DataFrame:
    """One text a group, its rows in order; for groups that a prompt can hold."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias(out))


def prompt(instruction: str, context: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n"), context, F.lit("\n\nQ: "), question, F.lit("\nA:"))


#: What stands between snippets, and around a question and the snippets that are to answer it.
SNIPPET_SEPARATOR = "\n---（片段分隔）---\n"
SNIPPET_TASK = "你是一個樂於助人的助手。\n請僅根據下面提供的「{0}」回答問題。\n若在片段中找不到答案，請回答「我不知道」。\n\n問題："
SNIPPET_LEAD, CHUNK_LEAD, ANSWER_TASK = ("上下文片段", "上下文片段"), ("高分片段", "高分片段（已重排）"), "\n\n請用完整句子作答："


def snippet_prompt(question: Column, context: Column, names: tuple[str, str] = SNIPPET_LEAD) -> Column:
    """A question over snippets (or, with CHUNK_LEAD, over reranked chunks) joined by SNIPPET_SEPARATOR."""
    return F.concat(F.lit(SNIPPET_TASK.format(names[0])), question, F.lit(f"\n\n{names[1]}：\n"), context, F.lit(ANSWER_TASK))


def map_reduce(docs: DataFrame, summarize, max_tokens: int = 100, overlap: int = 20, short: int = 60) -> DataFrame:
    """(doc_id, summary): chunks summarised, then their joined summaries; texts under ``short`` characters pass as they are.

    ``summarize`` maps a Column to a Column; a model is a pandas UDF, offline the first sentence does.
    """
    brief = F.length("text") < short
    chunks = docs.where(~brief).select("doc_id", F.posexplode(token_windows("text", max_tokens, overlap)).alias("pos", "chunk")).withColumn("part", summarize(F.col("chunk")))
    reduced = joined(chunks, ["doc_id"], "pos", "part", " ", "joined").select("doc_id", summarize(F.col("joined")).alias("summary"))
    return docs.where(brief).select("doc_id", F.col("text").alias("summary")).unionByName(reduced)


def chain(rows: DataFrame, steps: list[tuple[str, str, dict[str, str]]], model) -> DataFrame:
    """rows with a column for each step (name, template, inputs): the model's answer to the template, whose names are other columns.

    A step's inputs may be answers of steps before it.  ``model(name, prompt)`` maps a prompt, a Column, to an answer; a
    model outside Spark is a pandas UDF, and runs once a row and step.
    """
    for name, template, inputs in steps:
        rows = rows.withColumn(name, model(name, render(F.lit(template), {k: F.col(c) for k, c in inputs.items()})))
    return rows


def first_sentence(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([^.!?。！？]*[.!?。！？]?)", 1)
