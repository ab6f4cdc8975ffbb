"""Every query by name: (callable, SQL or None)."""

from __future__ import annotations

from . import flagship, language_queries, service_queries, source_queries, stream_queries, text_queries, vector_queries

ALL = {**source_queries.QUERIES, **text_queries.QUERIES, **vector_queries.QUERIES, **service_queries.QUERIES, **stream_queries.QUERIES,
    **language_queries.QUERIES, "answer_contexts": (flagship.answer_contexts, flagship.answer_sql())}


def queries():
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
