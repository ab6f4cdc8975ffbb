"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component, from ``edges(a, b)``.

    Each step sends every neighbour of a node to the smallest one known; rows stay as many as the
    edges at most.  Steps end when the edges stay the same; lineage is cut after each.
    """

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    def downward(rows: DataFrame) -> DataFrame:
        return rows.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(rows: DataFrame):
        r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    now = cut(downward(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before, seen = None, state(now)
    while seen != before and seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = downward(large)
        smallest = least(large)
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u",
            F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(downward(small))
        before, seen = seen, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def first_rows(points: DataFrame, edges: DataFrame) -> DataFrame:
    """k1 and k2 of the first row of each component of ``points(point, first)`` under ``edges(a, b)``; first ends with k1 and k2."""
    roots = connected(edges).withColumnRenamed("node", "point")
    least = points.join(roots, "point", "left").groupBy(F.coalesce("root", "point").alias("root")).agg(F.min("first").alias("first"))
    return least.select("first.k1", "first.k2")
