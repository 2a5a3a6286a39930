"""Parallel reads of a key range from a JDBC table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..plans.checks import require


def range_predicates(column: str, lower: int, upper: int, num_partitions: int) -> list[str]:
    """SQL predicates that cut the inclusive range [lower, upper] into equal parts.

    Rows outside the range belong to no part. Python integers do not overflow.
    """
    require(num_partitions >= 1, "num_partitions must be positive")
    require(lower <= upper, "lower must not exceed upper")
    length = upper - lower + 1
    edges = [lower + i * length // num_partitions for i in range(num_partitions + 1)]
    return [
        f"{column} >= {start} AND {column} <= {stop - 1}"
        for start, stop in zip(edges[:-1], edges[1:], strict=True)
    ]


def jdbc_range_scan(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    num_partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read rows with ``lower <= column <= upper``, one query per part.

    ``table`` may be a subquery in parentheses with an alias.
    """
    return spark.read.jdbc(
        url,
        table,
        predicates=range_predicates(column, lower, upper, num_partitions),
        properties=dict(properties or {}),
    )
