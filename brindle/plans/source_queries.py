"""Queries that write tables in the formats of the sources and sinks and read them back, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import normalized
from ..sources import tables as T
from .text_queries import _NORM

_REGION = "r_regionkey int, r_name string"


def _one_file(s, rows, kind):
    """A small table as a file that is one JSON array."""
    path = T.scratch_path(s, kind)
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.text(path)
    return path


def _files_of_one(s, rows, kind):
    """Rows as JSON documents, each a file of its own, written where the rows are."""
    path = T.scratch_path(s, kind)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def json_document(s, d):
    """A file that is one JSON array."""
    return T.json_document(s, _one_file(s, T.table(s, d, "region"), "json"), _REGION)


def _lines(s, d, blanks):
    path = T.scratch_path(s, "lines")
    row = F.to_json(F.struct(*[F.col(c) for c in T.table(s, d, "nation").columns]))
    T.table(s, d, "nation").select(F.explode(F.array(row, *[F.lit("")] * blanks)).alias("value")).write.text(path)
    return path


def json_lines(s, d):
    """JSON lines with a blank one behind each."""
    return T.json_lines(s, _lines(s, d, 1), "n_nationkey int, n_name string, n_regionkey int")


def json_lines_strict(s, d):
    return T.json_lines(s, _lines(s, d, 0), "n_nationkey int, n_name string, n_regionkey int", strict=True)


def candidates(s, d):
    """Candidate lists of the parts of each brand, written as JSON and read back."""
    p = T.table(s, d, "part").select(F.col("p_brand").alias("query"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("idx"),
        F.col("p_name").alias("text"), F.col("p_retailprice").alias("retriever_score"))
    return T.candidates(s, _files_of_one(s, T.candidates_json(p), "candidates")).withColumn("retriever_score", F.round("retriever_score", 4))


def reranked(s, d):
    """The first items of reranked lists."""
    item = F.struct(F.col("p_partkey").cast("int").alias("idx"), F.col("p_name").alias("text"))
    lists = T.table(s, d, "part").groupBy(F.col("p_brand").alias("query")).agg(F.sort_array(F.collect_list(item)).alias("reranked"))
    return T.reranked(s, _files_of_one(s, lists, "reranked"), 2).select("query", "pos", "idx", "text")


def faq_texts(s, d):
    """Question and answer texts from JSON strings."""
    faqs = F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("q"), F.concat(F.lit("is "), F.col("n_name")).alias("a")),
        F.struct(F.lit("x").alias("q"), F.lit("y").alias("a"))).alias("faqs")))
    return T.faq_texts(T.table(s, d, "nation").select(faqs.alias("json")))


def yaml_files(s, d):
    """Question and answer pairs of YAML files, with the file's version."""
    path = T.scratch_path(s, "yaml")
    text = F.concat(F.lit("version: 1."), F.col("r_regionkey").cast("string"), F.lit("\nfaq:\n  - q: who\n    a: "), F.col("r_name"))
    T.table(s, d, "region").select("r_regionkey", text.alias("value")).write.partitionBy("r_regionkey").text(path)

    def parse(document):
        return [(T.yaml_version(document), f["q"], f["a"]) for f in document["faq"]]

    return T.yaml_files(s, path, "version string, q string, a string", parse)


def _files(s, d):
    path = T.scratch_path(s, "texts")
    T.table(s, d, "region").select("r_regionkey", F.col("r_name").alias("value")).write.partitionBy("r_regionkey").text(path)
    return path


def whole_files(s, d):
    return T.texts(s, _files(s, d)).select("text")


def file_hashes(s, d):
    """The SHA-256 and MD5 of files, and the digest as a bundle's."""
    path = _files(s, d)
    files = T.file_versions(s, path)
    return files.join(T.sha256_of_files(s, path), "path").select("sha256", "md5", "digest")


def inline_rows(s, d):
    """Literals as a table."""
    return s.createDataFrame([(0, "first text"), (1, "second text")], "pos int, text string")


def paged_files(s, d):
    """Documents with pages, one of which can't be read: pages are the lines of a file."""

    def extract(content):
        for n, line in enumerate(content.decode().split("|")):
            if n == 1:
                yield None
            else:
                yield line.strip()

    path = T.scratch_path(s, "pages")
    T.table(s, d, "region").select("r_regionkey", F.concat("r_name", F.lit("|bad|end")).alias("value")).write.partitionBy("r_regionkey").text(path)
    return T.pages_by(s.read.format("binaryFile").load(path), extract).select("page", "text")


def index_round_trip(s, d):
    """An index of vectors, written and read: how long each vector is."""
    path = T.scratch_path(s, "index")
    rows = T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("chunk"), F.col("embedding").alias("vector"))
    T.write_index(rows, path, "test", "m", "2024-01-01")
    v = normalized("vector")
    return T.read_index(s, path).select("id", "chunk", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("length2"))


def appended_lines(s, d):
    """A knowledge base of JSON lines, overwritten once and then added to."""
    path = T.scratch_path(s, "kb")
    docs = T.kb_records(T.table(s, d, "documents"))
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    T.write_json(docs, path)
    T.write_json(docs.where(even), path)
    T.write_json(docs.where(~even), path, "append")
    return T.json_lines(s, path, T.KB).select("doc_id", "text_hash")


def eval_report(s, d):
    """Accuracy over the labels as a report file, read back."""
    path = T.scratch_path(s, "report")
    T.write_report(T.table(s, d, "labels").agg(F.count("*").alias("total"), F.round(F.avg("quality"), 6).alias("accuracy")), path)
    return T.json_document(s, path, "total bigint, accuracy double")


def saved_hashes(s, d):
    """The hashes that a gated run has saved."""
    path = T.scratch_path(s, "hashes")
    T.save_hashes(T.table(s, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("hash")), path)
    return s.read.schema("path string, hash string").parquet(path)


QUERIES = {
    "json_document": (json_document, "SELECT r_regionkey, r_name FROM region"),
    "json_lines": (json_lines, "SELECT * FROM nation"),
    "json_lines_strict": (json_lines_strict, "SELECT * FROM nation"),
    "candidates_scan": (candidates, "SELECT p_brand AS query, p_size AS rank, p_partkey AS idx, p_name AS text, round(p_retailprice, 4) AS retriever_score FROM part"),
    "reranked_scan": (reranked,
        "SELECT query, CAST(r - 1 AS INTEGER) AS pos, idx, text FROM (SELECT p_brand AS query, row_number() OVER (PARTITION BY p_brand "
        "ORDER BY p_partkey) AS r, CAST(p_partkey AS INTEGER) AS idx, p_name AS text FROM part) WHERE r <= 2"),
    "faq_texts": (faq_texts, "SELECT CAST(0 AS INTEGER) AS pos, 'Q: ' || n_name || ' A: is ' || n_name AS text FROM nation UNION ALL SELECT 1, 'Q: x A: y' FROM nation"),
    "yaml_files": (yaml_files, "SELECT '1.' || r_regionkey AS version, 'who' AS q, r_name AS a FROM region"),
    "whole_files": (whole_files, "SELECT r_name || chr(10) AS text FROM region"),
    "file_hashes": (file_hashes, "SELECT sha256(r_name || chr(10)) AS sha256, md5(r_name || chr(10)) AS md5, 'sha256:' || sha256(r_name || chr(10)) AS digest FROM region"),
    "inline_rows": (inline_rows, "SELECT CAST(0 AS INTEGER) AS pos, 'first text' AS text UNION ALL SELECT 1, 'second text'"),
    "paged_files": (paged_files, "SELECT CAST(0 AS INTEGER) AS page, r_name AS text FROM region UNION ALL SELECT 2, 'end' FROM region"),
    "index_round_trip": (index_round_trip, "SELECT vec_id AS id, CAST(label AS VARCHAR) AS chunk, 1.0::DOUBLE AS length2 FROM embeddings"),
    "appended_lines": (appended_lines, f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256({_NORM.format('text')}) AS text_hash FROM documents"),
    "eval_report": (eval_report, "SELECT count(*) AS total, round(avg(quality), 6) AS accuracy FROM labels"),
    "saved_hashes": (saved_hashes, "SELECT url AS path, sha256(html) AS hash FROM pages"),
}
