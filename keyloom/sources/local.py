"""Datasets made from values in the program."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.checks import require


def from_rows(
    spark: SparkSession, rows: Sequence[Any], schema: T.StructType | str, num_slices: int | None = None
) -> DataFrame:
    """Distribute local rows in contiguous slices, in order.

    Without ``num_slices`` Spark chooses the number of slices.
    """
    if num_slices is None:
        return spark.createDataFrame(rows, schema)
    require(num_slices >= 1, "num_slices must be positive")
    # parallelize keeps slice i at rows [i*len/n, (i+1)*len/n)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, num_slices), schema)


def range_source(
    spark: SparkSession, start: int, end: int, step: int = 1, num_slices: int | None = None
) -> DataFrame:
    """Half-open range of longs in column ``id``; the step may be negative, not zero."""
    require(step != 0, "step must not be zero")
    return spark.range(start, end, step, num_slices)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A dataset with a schema and no rows."""
    return spark.createDataFrame([], schema)
