"""Operator 10: a content-addressed web archive: payloads once, record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_path

#: Equal payloads of at least so many bytes are stored as one response and revisits of it.
LEAST_BYTES = 100
#: Fixed value: the profile of a revisit with identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = "\r\n"
#: Stands for a null page_id in a join.
NO_PAGE = -(2**63)


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record_headers(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The exact header block of a record, as text."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_LINE))).otherwise("")

    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{_LINE}"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(_LINE),
    )


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes ``path``/payloads (digest, payload) and ``path``/records (page_id, url, digest, header).

    pages(page_id, url, html): a null page is an empty payload, a null url has no header line.  A line break in
    a url is percent-encoded in the header; the url itself is kept as it was, in its own column.  Of records
    with equal payloads of LEAST_BYTES or more, those with the smallest page_id are responses, others
    revisits; smaller payloads are all responses.  Groups are summed by digest before anything moves, and
    rows meet by digest and page_id, so that a group of most rows is spread.  A payload whose text differs
    from another of the same digest stops the job.
    """
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("check", F.xxhash64("payload"))
    keyed = rows.select("page_id", "url", "digest", "bytes", "check")
    groups = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min("check").alias("c1"), F.max("check").alias("c2"),
        F.min("bytes").alias("b1"), F.max("bytes").alias("b2"))
    clash = (F.col("c1") != F.col("c2")) | (F.col("b1") != F.col("b2"))
    groups = groups.select("digest", F.when(clash, F.raise_error(F.lit("two payloads share a digest"))).otherwise(F.col("refers_to")).alias("refers_to"))
    revisit = (F.col("bytes") >= LEAST_BYTES) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    joined = keyed.join(groups, "digest").withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    joined.select("page_id", "url", "digest", F.encode(record_headers(), "UTF-8").alias("header")).write.parquet(f"{path}/records")
    # plain keys, so that payloads move once: equal rows meet where the join has put them
    first = groups.select("digest", F.coalesce("refers_to", F.lit(NO_PAGE)).alias("key"))
    stored = rows.select("digest", F.coalesce("page_id", F.lit(NO_PAGE)).alias("key"), "payload").join(first, ["digest", "key"], "left_semi")
    stored.dropDuplicates(["digest", "key"]).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _header(name: str) -> Column:
    found = F.regexp_extract(F.col("text"), f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload; a payload that isn't what its digest says stops the job."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))
    return stored.select(F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(bad).alias("digest"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, header, and what the header says: digest, record_type, refers_to (a record's id)."""
    rows = spark.read.schema("page_id long, url string, digest string, header binary").parquet(f"{path}/records").withColumn("text", F.decode("header", "UTF-8"))
    return rows.select("page_id", "url", "header", F.regexp_replace(_header("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        _header("WARC-Type").alias("record_type"), _header("WARC-Refers-To").alias("refers_to"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record, payload: the original bytes of each record, and what it stands for.

    A response is its header and payload; a revisit its header and, as its Content-Length says, an empty
    block; its payload is found by its digest.
    """
    end = F.encode(F.lit(_LINE * 2), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_records(spark, path).join(read_payloads(spark, path), "digest").select("page_id", F.concat("header", block, end).alias("record"), "payload")


def archived(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the files alone."""
    sizes = read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    to = F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]+)>$", 1)
    return read_records(spark, path).join(sizes, "digest").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.when(to != "", to.cast("long")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return archived(spark, path)


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT d, min(page_id) AS m FROM p GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= {LEAST_BYTES} AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p JOIN g ON p.d = g.d
"""
