"""Row numbers without a task that sees every row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, at about so many of which a window sorts in memory, and slices at most in one search of the bounds.
SLICE_ROWS, MOST_SLICES = 1_000_000, 4_096


def bounds_type(bounds: list) -> str:
    return "bigint" if all(isinstance(b, int) for b in bounds) else "double"


def _bounds_below(bounds: list):
    """How many of the sorted bounds are below each value, none for a null; looked up in Arrow batches."""
    edges = np.array(bounds)

    @F.arrow_udf("int")
    def below(values: pa.Array) -> pa.Array:
        found = np.searchsorted(edges, values.fill_null(edges[0].item()).to_numpy(zero_copy_only=False), side="left")
        return pa.array(found.astype(np.int32))  # what isn't known is in the first slice

    return below


def numbered(rows: DataFrame, order: str, out: str) -> DataFrame:
    """``rows`` with ``out``: places from 1 in ascending ``order`` (a numeric column; nulls first, ties in any order).

    Slices are cut at quantiles of ``order``; their counts are added up first, so each slice numbers its own
    rows.  Bounds are values, so a slice that is computed again is the same.  Rows of one value share a slice.
    """
    total = rows.count()
    slices = min(MOST_SLICES, -(-total // SLICE_ROWS))
    bounds = rows.agg(F.percentile_approx(order, [(i + 1) / slices for i in range(slices - 1)], 100_000).alias("b")).first().b if slices > 1 else None
    bounds = sorted(set(bounds or ()))
    sliced = rows.withColumn("_slice", _bounds_below(bounds)(F.col(order).cast(bounds_type(bounds))) if bounds else F.lit(0))
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_in"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))  # MOST_SLICES rows at most
    inner = Window.partitionBy("_slice").orderBy(order)
    return sliced.withColumn(out, F.row_number().over(inner)).join(F.broadcast(starts), "_slice").withColumn(out, F.col(out) + F.col("_start")).drop("_slice", "_start")
