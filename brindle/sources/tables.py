"""Reading and writing: tables, JSON and JSON lines, YAML, texts, files, web pages."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import paragraphs

#: Schemas of files; nothing is inferred.
RERANKED = "query string, model string, reranked array<struct<idx:int,title:string,source:string,text:string,retriever_score:double,reranker_score:double>>"
CANDIDATES = "query string, candidates array<struct<rank:int,idx:bigint,text:string,retriever_score:double>>"
FAQ = "faqs array<struct<q:string,a:string>>"
KB = "doc_id string, text string, text_hash string"
INDEX = "meta struct<source:string,generated_at:string,model:string>, items array<struct<id:int,chunk:string,vector:array<float>>>"


#: Settings of the rows that go to a Python worker at once, Spark's default and ours: a worker holds a batch, what is made of it and the next one.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; its rows go to Python in small batches, where the session has made no choice."""
    for key, (default, ours) in _BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON value; a broken one stops the job."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One JSON value a line; blank lines are skipped, broken ones are nulls; ``strict``: either stops the job."""
    if not strict:
        return spark.read.option("mode", "PERMISSIVE").schema(schema).json(path)
    line = F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line"))).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The items of candidate files with their query."""
    return json_document(spark, path, CANDIDATES).select("query", F.explode("candidates").alias("c")).select("query", "c.*")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir.

    Where a session names none, a local one gets a temporary folder; on a cluster that would be lost or unseen, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def question_bank(rows: DataFrame) -> DataFrame:
    """(doc_id, style, question) of bank(doc_id, styles): questions by style, each in its order."""
    return rows.select("doc_id", F.explode("styles").alias("style", "qs")).select("doc_id", "style", F.explode("qs").alias("question"))


def reranked(spark: SparkSession, path: str, top_n: int | None = None) -> DataFrame:
    """The items of reranked files, the first ``top_n`` of each query, with their place."""
    rows = json_document(spark, path, RERANKED).select("query", F.posexplode("reranked").alias("pos", "item")).select("query", "pos", "item.*")
    return rows if top_n is None else rows.where(F.col("pos") < top_n)


def faq_texts(rows: DataFrame, column: str = "json") -> DataFrame:
    """(pos, text): "Q: … A: …" of each question in a JSON text."""
    items = rows.select(F.posexplode(F.from_json(column, FAQ)["faqs"]).alias("pos", "faq"))
    return items.select("pos", F.concat(F.lit("Q: "), F.col("faq.q"), F.lit(" A: "), F.col("faq.a")).alias("text"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_versions(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, sha256, md5) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def yaml_files(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    """Rows of YAML files: ``parse(document)`` gives tuples of ``schema``; files are read in the tasks."""
    import yaml

    names = T.StructType.fromDDL(schema).names

    def rows(batches):
        import pandas as pd

        for b in batches:
            found = [r for text in b["value"] for r in parse(yaml.safe_load(text))]
            yield pd.DataFrame(found, columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(rows, schema)


def yaml_version(document: dict | None) -> str:
    return str((document or {}).get("version", "0.0.0"))


def pages_by(binary: DataFrame, extract, on_error: str = "skip") -> DataFrame:
    """(path, page, text) of documents with pages: ``extract(bytes)`` yields page texts; a failing page is skipped.

    A table function in a lateral join: pages leave as the extractor gives them, and a document's pages are never
    gathered.  The extractor (for PDF and the like) is the caller's, as no such library is assumed.  It may yield
    None, or an exception, for a page that can't be read; one that it raises ends the document.  Pages without text
    are named in the task's log.
    """

    class Pages:
        def eval(self, path: str, content: bytes):
            pages, n = iter(extract(content)), 0
            while True:
                try:
                    text = next(pages)
                except StopIteration:
                    return
                except Exception as failed:
                    text = failed
                if isinstance(text, Exception):
                    if on_error != "skip":
                        raise text
                    text = None
                if text is not None:
                    if not text.strip():
                        logging.getLogger(__name__).warning("%s: page %d has no text", path, n)
                    yield n, text
                n += 1

    pages = F.udtf(Pages, returnType="page int, text string")
    return binary.select("path", "content").lateralJoin(pages(F.col("path").outer(), F.col("content").outer())).select("path", "page", "text")


def web_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, text) of every paragraph of pages(page_id, html)."""
    return pages.select("page_id", F.posexplode(paragraphs("html")).alias("pos", "text"))


def kb_records(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash) with white space normalised; the hash gives the id of a text that has none."""
    from ..functions.text import norm_ws

    text = norm_ws("text")
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("doc_"), F.left(F.sha2(text, 256), F.lit(8)))).alias("doc_id"),
        text.alias("text"), F.sha2(text, 256).alias("text_hash"))


# sinks


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; mode append adds to a knowledge base."""
    df.write.mode(mode).json(path)


def write_index(vectors: DataFrame, path: str, source: str, model: str, generated_at: str) -> None:
    """``path``/items (id, chunk, vector) and ``path``/meta; an item without chunk or vector stops the job."""
    broken = F.raise_error(F.lit("a chunk without a vector, or a vector without a chunk"))
    whole = vectors.select("id", F.when(F.col("chunk").isNull() | F.col("vector").isNull(), broken).otherwise(F.col("chunk")).alias("chunk"), "vector")
    whole.write.mode("overwrite").parquet(f"{path}/items")
    vectors.sparkSession.createDataFrame([(source, generated_at, model)], "source string, generated_at string, model string").write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The items of an index; one that is missing, or has no item, stops the job."""
    items = spark.read.schema("id bigint, chunk string, vector array<float>").parquet(f"{path}/items")
    if items.isEmpty():
        raise ValueError(f"no items in {path}")
    return items


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file of a small report."""
    report.coalesce(1).write.mode("overwrite").json(path)


def save_hashes(files: DataFrame, path: str) -> None:
    """(path, hash) of what a gated run has built: written last, so that a run that failed is made again."""
    files.select("path", "hash").write.mode("overwrite").parquet(path)


def bundle(spark: SparkSession, files: str, out: str) -> str:
    """A tar.gz of a folder's few small files at ``out`` (a driver's utility), and its digest; none there stops the job."""
    import hashlib
    import io
    import tarfile

    rows = spark.read.format("binaryFile").load(files).select("path", "content").orderBy("path").collect()
    if not rows:
        raise ValueError(f"no files in {files}")
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for r in rows:
            info = tarfile.TarInfo(r.path.rsplit("/", 1)[-1])
            info.size = len(r.content)
            tar.addfile(info, io.BytesIO(r.content))
    with open(out, "wb") as f:
        f.write(data.getvalue())
    return "sha256:" + hashlib.sha256(data.getvalue()).hexdigest()


def candidates_json(ranked: DataFrame) -> DataFrame:
    """(query, candidates) from (query, rank, idx, text, retriever_score): one JSON-ready row a query."""
    item = F.struct("rank", "idx", "text", "retriever_score")
    return ranked.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the highest version: an upsert, or a metadata map.  Rows merge before they are shuffled."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def sha256_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) with digest as "sha256:<hex>", of a bundle's files."""
    return file_versions(spark, path).select("path", F.concat(F.lit("sha256:"), "sha256").alias("digest"))


def _label(c: str) -> Column:
    """A label's value: back-slashes, quotes and line breaks escaped."""
    out = F.col(c).cast("string")
    for letter, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(letter), F.lit(escaped))
    return F.concat(F.lit(f'{c}="'), F.coalesce(out, F.lit("")), F.lit('"'))


def exposition(counters: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(line): a counter in the text format of metric scrapers; a histogram's buckets with le among the labels."""
    return counters.select(F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *map(_label, labels)), F.lit("} "), F.col(value).cast("string")).alias("line"))


def exposition_json(counters: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(line): a counter as JSON: its name, labels and value."""
    return counters.select(F.to_json(F.struct(F.lit(name).alias("name"), F.struct(*labels).alias("labels"), F.col(value).alias("value"))).alias("line"))
