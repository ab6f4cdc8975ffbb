"""Operator 9: token counts by a two-tier lookup inside the map tasks; no text's pre-tokens are shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .tokens import LONGEST, PieceEncoder, length_encoder

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the broadcast table, which is all that the driver gets, and of a task's counts, which it sends when they are more.
TABLE_ENTRIES, COUNTED = 65_536, 300_000
TOKEN_LIMIT = 1024


def frequent_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token lengths of the pre-tokens that are most frequent in all documents, ties in their order.

    The table only saves work: pre-tokens outside it are encoded by the library in the worker that meets them.
    Tasks add up the pre-tokens of their whole texts; only these sums are shuffled, for the table.
    """
    counted = COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, pieces, found = length_encoder(vocabulary), Counter(), Counter()
        for b in batches:
            for t in b.column(0):
                pieces.update(cutter.pieces(t.as_py() or "") or ())
                if len(pieces) > entries:
                    _spread(pieces, cutter, found)
                    if len(found) > counted:
                        yield from _told(found)
        _spread(pieces, cutter, found)
        yield from _told(found)
        cutter.forget()

    sums = docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    library = PieceEncoder(vocabulary, len, sum)
    return {r.token: library._token(r.token) for r in sums.orderBy(F.desc("n"), "token").limit(entries).select("token").collect()}


def _told(found: Counter) -> Iterator[pa.RecordBatch]:
    """The counts in batches; they are emptied."""
    rows = list(found.items())
    found.clear()
    for at in range(0, len(rows), 50_000):
        tokens, n = zip(*rows[at : at + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(n, pa.int64())], ["token", "n"])


def _spread(pieces: Counter, cutter: PieceEncoder, found: Counter) -> None:
    """Moves counts of pieces to their pre-tokens."""
    for piece, n in pieces.items():
        for p in cutter.pre_tokens(piece) or ():
            if len(p) <= LONGEST:
                found[p] += n
    pieces.clear()


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs(doc_id, text)``.

    A null text counts as an empty one (no bytes, no tokens); repeated rows give repeated rows; null
    ids pass through; an empty table gives an empty one; other columns are ignored.  A text is cut at its
    white space; a piece that the worker has not met lately is cut into pre-tokens, whose lengths come
    from the broadcast table (first tier) or from the worker's own cache, filled by the library (second).
    """
    docs = pick(docs, "doc_id", "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = length_encoder(vocabulary)
        lengths.known(frequent.value)
        for b in batches:
            sizes, sums = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                sizes.append(len(text.encode()))
                sums.append(sum(lengths.values(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        lengths.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
