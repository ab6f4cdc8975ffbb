"""A store of vectors with their metadata that batches are merged into."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import topk
from .tables import latest

SCHEMA = "id long, vector array<float>, metadata map<string,string>, deleted boolean, version long, bucket int"


class VectorStore:
    """Vectors by id below ``path``, in folders by version and by bucket of the id.

    ``upsert`` and ``delete`` write a version's folder; a batch that is run again replaces its own.  The newest
    version of an id counts.  ``compact`` merges all versions into one, in a new generation that counts once it is
    whole, and leaves the old one's files to readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        return self._read(f"{self.path}/generations/*", "generation long").agg(F.coalesce(F.max("generation"), F.lit(0).cast("long"))).first()[0]

    def upsert(self, batch: DataFrame, version: int) -> None:
        """Puts in batch(id, vector, metadata); of an id that is there more than once, the row with the greatest ``version`` counts,
        and inside a batch the last by metadata and vector."""
        rows = batch.select("id", F.col("vector").cast("array<float>").alias("vector"),
            F.col("metadata").cast("map<string,string>").alias("metadata"), F.lit(False).alias("deleted"))
        order = F.struct(F.to_json("metadata"), "vector")
        one = rows.groupBy("id").agg(F.max_by(F.struct("vector", "metadata", "deleted"), order).alias("r")).select("id", "r.*")
        self._write(one, version)

    def delete(self, ids: DataFrame, version: int) -> None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("vector", "array<float>"), ("metadata", "map<string,string>"))]
        self._write(ids.select("id").distinct().select("id", *none, F.lit(True).alias("deleted")), version)

    def _write(self, rows: DataFrame, version: int, generation: int | None = None) -> None:
        named = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")).repartition("bucket")
        generation = self.generation() if generation is None else generation
        named.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{generation}/version={version}")

    def versions(self) -> DataFrame:
        return self._read(f"{self.path}/rows/{self.generation()}", SCHEMA)

    def rows(self, ids: list[int] | None = None) -> DataFrame:
        """(id, vector, metadata, version) of what is there; for some ids only their buckets are read."""
        every = self.versions()
        if ids is not None:
            wanted = self.spark.createDataFrame([(i,) for i in ids], "id long")
            buckets = [r.b for r in wanted.select(F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
            every = every.where(F.col("bucket").isin(buckets) & F.col("id").isin(ids))
        return latest(every.drop("bucket"), ["id"], "version").where(~F.col("deleted")).drop("deleted")

    def compact(self) -> None:
        now, every = self.generation(), self.versions()
        last = every.agg(F.max("version")).first()[0]
        if last is None:
            return
        self._write(self.rows().drop("version").withColumn("deleted", F.lit(False)), last, now + 1)
        self.spark.createDataFrame([(now + 1,)], "generation long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/generations/{now + 1}")

    def nearest(self, queries: DataFrame, k: int, metric: str = "cosine", where=None) -> DataFrame:
        """The k nearest of queries(qid, vector), with their metadata; ``where``: a condition on metadata."""
        rows = self.rows() if where is None else self.rows().where(where)
        best = topk(queries, rows, k, metric, "qid", "id", "vector")
        return best.join(rows.select(F.col("id").alias("vec_id"), "metadata"), "vec_id")
