"""Tables kept in buckets of a key, so that joins, sums and unions on it move no rows.

A bucketed table is written once with the hash placement that joins and aggregations would ask
for. What reads it plans no exchange: ``joins.join(a, b, key, null_safe=False)`` and
``aggregates.reduce_by_key(a, key, …)`` work in place when both tables have the same number of
buckets. (A null-safe join compares an expression of the key, which no table is placed by.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.checks import as_list, require, require_columns
from ..plans.keys import cols


def write_bucketed(
    df: DataFrame, table: str, keys: str | Sequence[str], buckets: int, path: str | None = None, sort: bool = True
) -> None:
    """Save ``df`` as a table of ``buckets`` buckets of the keys, one file each.

    A table of that name is an error. ``path`` is where its files go, else the warehouse.
    """
    names = as_list(keys)
    require(buckets >= 1, "buckets must be positive")
    require_columns(df, names)
    # rows are placed before they are written, else every task would write every bucket
    writer = df.repartition(buckets, *cols(names)).write.bucketBy(buckets, *names)
    if sort:
        writer = writer.sortBy(*names)
    if path is not None:
        writer = writer.option("path", path)
    writer.mode("errorifexists").saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def layout_of(df: DataFrame) -> tuple[list[str], int] | None:
    """(columns, number) when equal values of the columns share a partition already.

    True of bucketed tables and of what was placed by hash with a given number; filters and
    projections that keep the columns keep it.
    """
    placed = df._jdf.queryExecution().sparkPlan().outputPartitioning()
    if placed.getClass().getSimpleName() != "HashPartitioning":
        return None
    expressions = placed.expressions()
    parts = [expressions.apply(i) for i in range(expressions.size())]
    if not all(p.getClass().getSimpleName() == "AttributeReference" for p in parts):
        return None
    return [p.name() for p in parts], placed.numPartitions()
