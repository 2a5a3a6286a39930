"""Positions: indexes, unique ids and zips. DataFrames have no order, so one is declared."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.checks import as_list, require, require_columns
from ..plans.keys import cols
from ..plans.prefix import with_position
from .arrow import as_struct


def zip_with_index(
    df: DataFrame,
    order_by: str | Sequence[str] | None = None,
    name: str = "index",
    on_tie: str = "error",
) -> DataFrame:
    """Add a 0-based consecutive index in the order of ``order_by``.

    A tie makes positions undefined and is an error; ``on_tie="any"`` accepts any order
    among equal rows and saves the check. Without ``order_by`` the index follows the order
    the rows have: partition by partition, as after ``sort_by_key``.
    """
    require(on_tie in ("error", "any"), "on_tie is 'error' or 'any'")
    order = as_list(order_by)
    require_columns(df, order)
    indexed, _ = _indexed(df, order, name, on_tie)
    return indexed


def _indexed(df: DataFrame, order: list[str], name: str, on_tie: str) -> tuple[DataFrame, int]:
    return with_position(df, cols(order) or None, name, unique=on_tie == "error")


def zip_with_unique_id(df: DataFrame, name: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Add id ``i*n + k`` for row i of partition k of n; no shuffle and no extra job.

    ``num_partitions`` saves planning the input twice; a number that is too small raises.
    """
    n = num_partitions or df.rdd.getNumPartitions()
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    partition = F.spark_partition_id()
    checked = F.when(partition < n, partition).otherwise(
        F.raise_error(F.lit(f"more than {n} partitions")).cast("int")
    )
    return df.withColumn(name, row * F.lit(n) + checked)


def zip_tables(
    left: DataFrame,
    right: DataFrame,
    left_order: str | Sequence[str],
    right_order: str | Sequence[str],
) -> DataFrame:
    """Pair two datasets by position in their declared orders; unequal lengths raise."""
    clash = set(left.columns) & set(right.columns)
    require(not clash, f"both sides have {sorted(clash)}")
    a, count_a = _indexed(left, as_list(left_order), "__pos", "error")
    b, count_b = _indexed(right, as_list(right_order), "__pos", "error")
    require(count_a == count_b, f"cannot zip {count_a} rows with {count_b} rows")
    return a.join(b, "__pos").drop("__pos")


def zip_partitions(
    datasets: Sequence[DataFrame],
    f: Callable[..., Iterator[pd.DataFrame]],
    schema: T.StructType | str,
    num_partitions: int,
    partition: Column | None = None,
) -> DataFrame:
    """Call ``f`` with the rows of equal-numbered partitions of two to four datasets.

    Rows are placed by ``partition`` (an id expression all datasets can compute, from 0 to
    ``num_partitions`` - 1; another id is an error). Without it they stay in the partition
    they are in, and every dataset must have ``num_partitions`` of them. ``f`` gets one pandas
    frame per dataset, so the partitions of one number must fit in a task together.
    """
    require(2 <= len(datasets) <= 4, "two to four datasets can be zipped")
    if partition is None:
        counts = [df.rdd.getNumPartitions() for df in datasets]
        require(set(counts) == {num_partitions}, f"cannot zip {counts} partitions as {num_partitions}")
    given = (F.spark_partition_id() if partition is None else partition).cast("int")
    place = F.when((given >= 0) & (given < num_partitions), given).otherwise(
        F.raise_error(F.lit(f"a partition id is outside 0 to {num_partitions - 1}")).cast("int")
    )
    names = [f"__row{i}" for i in range(len(datasets))]
    tagged = []
    for i, df in enumerate(datasets):
        sides = [
            (F.struct("*") if j == i else F.lit(None).cast(other.schema)).alias(names[j])
            for j, other in enumerate(datasets)
        ]
        tagged.append(df.select(place.cast("int").alias("__place"), F.lit(i).alias("__side"), *sides))
    together = tagged[0]
    for other in tagged[1:]:
        together = together.union(other)
    placed = together.repartitionById(num_partitions, F.col("__place"))
    columns = [df.columns for df in datasets]

    result = to_arrow_schema(as_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[pa.Table]] = [[] for _ in columns]
        for batch in batches:
            sides = batch.column("__side")
            for i, name in enumerate(names):
                rows = batch.column(name).filter(pc.equal(sides, i))
                if len(rows):
                    parts[i].append(pa.Table.from_arrays(rows.flatten(), names=columns[i]))
        if any(parts):
            frames = [
                pa.concat_tables(p).to_pandas() if p else pd.DataFrame(columns=c)
                for p, c in zip(parts, columns, strict=True)
            ]
            for frame in f(*frames):
                yield pa.RecordBatch.from_pandas(frame, schema=result, preserve_index=False)

    return placed.mapInArrow(run, schema)
