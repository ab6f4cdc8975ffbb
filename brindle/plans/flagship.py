"""The flagship: documents cut into chunks, embedded, searched, and joined to contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions.vectors import hash_matrix, hash_vector
from ..operators.context import joined
from ..operators.search import topk
from ..sources.tables import table


def answer_contexts(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """(qid, context): the k chunks of all documents most like each benchmark item, by hashed vectors, as one text.

    A chunk is named by its document and number; the texts of those found are cut out of their documents again.
    """
    docs, cut = table(spark, sf_dir, "documents"), C.sliding("text", 1000, 100)
    chunks = C.rows(docs, cut).withColumn("chunk", F.concat_ws(":", "doc_id", F.lpad(F.col("chunk_id").cast("string"), 9, "0")))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), hash_vector("text").alias("embedding"))
    best = topk(items, chunks, k, "dot", base_id="chunk", digits=6, embed=hash_matrix).withColumn("doc_id", F.split("vec_id",
        ":")[0].cast("long")).withColumn("at", F.split("vec_id", ":")[1].cast("int"))
    found = best.join(docs.select("doc_id", "text"), "doc_id").select("qid", "rank", F.element_at(cut, F.col("at") + 1).alias("text"))
    return joined(found, ["qid"], "rank")


_SIZE, _STEP = 1000, 900
_CHUNKS = f"""c AS (SELECT doc_id, CAST(i AS BIGINT) AS i, substr(text, i * {_STEP} + 1, {_SIZE}) AS text
    FROM (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE 1 + ceil(greatest(length(text) - {_SIZE}, 0) / {_STEP}) END AS BIGINT))) AS i FROM documents))"""
_SCORED = """s AS (SELECT q.id AS qid, d.id AS chunk, round(sum(q.v * d.v), 6) AS score FROM nq q JOIN nd d USING (slot) GROUP BY ALL),
k AS (SELECT qid, chunk, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) AS rank FROM s)"""


def answer_sql(k: int = 3) -> str:
    from .vector_queries import _HASHED

    named = "(SELECT doc_id || ':' || lpad(i::VARCHAR, 9, '0') AS chunk, text FROM c)"
    return f"""
WITH {_CHUNKS}, {_HASHED.format("d", "chunk", named)}, {_HASHED.format("q", "item_id", "benchmark")}, {_SCORED}
SELECT qid, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
FROM k JOIN c ON k.chunk = c.doc_id || ':' || lpad(c.i::VARCHAR, 9, '0') WHERE rank <= {k} GROUP BY qid
"""
