"""Set operations on whole rows. Nulls are equal, NaN equals NaN, -0.0 equals 0.0."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import require
from ..plans.keys import cols
from .bucketed import layout_of
from .joins import subtract_by_key


def union(datasets: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name.

    Inputs that are placed alike, such as tables of equal buckets, are united partition by
    partition, and what follows on their key moves no rows. Spark 4.1 promises as much for any
    such union, but appends the partitions of inputs that it reads as column batches; a filter
    that every row passes makes them rows first.
    """
    require(bool(datasets), "at least one dataset is needed")
    first = layout_of(datasets[0]) if len(datasets) > 1 else None
    if first is not None and all(layout_of(d) == first for d in datasets[1:]):
        datasets = [d.filter(F.spark_partition_id() >= 0) for d in datasets]
    return reduce(DataFrame.unionByName, datasets)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows present on both sides.

    One shuffle for both: copies are merged before it, so they cannot form a hot group.
    """
    names = left.columns
    tagged = left.withColumn("__side", F.lit(1)).unionByName(
        right.select(*cols(names)).withColumn("__side", F.lit(2))
    )
    return (
        tagged.groupBy(*cols(names))
        .agg(F.bit_or("__side").alias("__sides"))
        .filter(F.col("__sides") == 3)
        .drop("__sides")
    )


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` not in ``right``, with all their copies."""
    return subtract_by_key(left, right.select(*cols(left.columns)), left.columns)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
