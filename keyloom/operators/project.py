"""Projections, filters and per-partition transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.checks import as_list, key_and_values, require, require_columns
from ..plans.keys import all_of, cols, quoted
from .arrow import map_row_iterator


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One output row per input row, made of named expressions."""
    return df.select(*[expr.alias(name) for name, expr in columns.items()])


def map_function(
    df: DataFrame, f: Callable[[dict[str, Any]], Any], schema: T.StructType | str
) -> DataFrame:
    """``map_rows`` for a Python function of one row; the slow path."""
    return map_row_iterator(df, lambda rows: map(f, rows), schema)


def flat_map(df: DataFrame, items: Column, name: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Zero or more output rows per row: one per element of an array expression."""
    return df.select(*cols(keep), F.explode(items).alias(name))


def flat_map_function(
    df: DataFrame, f: Callable[[dict[str, Any]], Iterable[Any]], schema: T.StructType | str
) -> DataFrame:
    def run(rows: Iterator[dict[str, Any]]) -> Iterator[Any]:
        for row in rows:
            yield from f(row)

    return map_row_iterator(df, run, schema)


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def partial_map(df: DataFrame, defined: Column, **columns: Column) -> DataFrame:
    """Keep the rows where a partial function is defined and apply it."""
    return map_rows(df.filter(defined), **columns)


def map_partitions(
    df: DataFrame,
    f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Batches in, batches out, one call per partition."""
    return df.mapInPandas(f, schema)


def map_partitions_with_index(
    df: DataFrame,
    f: Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """``map_partitions`` whose function also receives the partition id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(TaskContext.get().partitionId(), batches)

    return df.mapInPandas(run, schema)


def with_partition_index(df: DataFrame, name: str = "partition") -> DataFrame:
    return df.withColumn(name, F.spark_partition_id())


def _with_resource(build, apply):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource = build(TaskContext.get().partitionId())
        for batch in batches:
            yield apply(resource, batch)

    return run


def map_with(
    df: DataFrame,
    build: Callable[[int], Any],
    f: Callable[[Any, pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Build a resource once per partition from its id and pass it along with each batch.

    The batch function may return fewer, as many or more rows, so this is also the flat-map
    form.
    """
    return df.mapInPandas(_with_resource(build, f), schema)


flat_map_with = map_with


def filter_with(
    df: DataFrame, build: Callable[[int], Any], f: Callable[[Any, pd.DataFrame], Any]
) -> DataFrame:
    """Keep the rows for which the batch predicate is true; the rows themselves stay in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resource = build(TaskContext.get().partitionId())
        for batch in batches:
            keep = np.asarray(f(resource, batch.to_pandas()), dtype=bool)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def foreach_with(
    df: DataFrame, build: Callable[[int], Any], f: Callable[[Any, Any], None]
) -> None:
    def effect(rows: Iterable[Any]) -> None:
        resource = build(TaskContext.get().partitionId())
        for row in rows:
            f(resource, row)

    df.foreachPartition(effect)


def seeded_generator(seed: int) -> Callable[[int], np.random.Generator]:
    """Builder of a random generator seeded by ``seed`` and the partition id."""
    return lambda partition: np.random.default_rng([seed, partition])


def key_by(df: DataFrame, key: Column, name: str = "key", keep_row: bool = False) -> DataFrame:
    """Put a computed key in front; ``keep_row`` nests the row as one struct column."""
    if keep_row:
        return df.select(key.alias(name), F.struct("*").alias("row"))
    return df.select(key.alias(name), "*")


def map_values(df: DataFrame, keys: str | Sequence[str], **columns: Column) -> DataFrame:
    """Replace the value columns by expressions; keys are untouched."""
    key_names, _ = key_and_values(df, keys)
    return df.select(*cols(key_names), *[e.alias(n) for n, e in columns.items()])


def flat_map_values(
    df: DataFrame, keys: str | Sequence[str], items: Column, name: str = "value"
) -> DataFrame:
    """Repeat the keys for every element of an array expression over the values."""
    key_names, _ = key_and_values(df, keys)
    return flat_map(df, items, name, key_names)


def keys_of(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return df.select(*cols(as_list(keys)))


def values_of(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    _, values = key_and_values(df, keys)
    return df.select(*cols(values))


def glom(df: DataFrame, name: str = "rows") -> DataFrame:
    """(partition, rows): one array per partition; an empty partition gives an empty array.

    Runs inside the partition without a shuffle; a partition must fit in its task.
    """
    struct = T.StructType(
        [
            T.StructField("partition", T.IntegerType()),
            T.StructField(name, T.ArrayType(df.schema)),
        ]
    )
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"partition": part, name: rows}], schema=out)

    return df.mapInArrow(run, struct)


def filter_by_range(df: DataFrame, column: str, lower: Any, upper: Any) -> DataFrame:
    """Rows with ``lower <= column <= upper``; file statistics prune clustered data."""
    return df.filter(F.col(quoted(column)).between(lower, upper))


def lookup(df: DataFrame, keys: str | Sequence[str], key: Any) -> DataFrame:
    """All values of one key; a null key finds null keys."""
    key_names, values = key_and_values(df, keys)
    parts = list(key) if isinstance(key, (tuple, list)) else [key]
    require(len(parts) == len(key_names), "one value per key column is needed")
    condition = all_of([c.eqNullSafe(F.lit(v)) for c, v in zip(cols(key_names), parts, strict=True)])
    return df.filter(condition).select(*cols(values))


def prune_partitions(df: DataFrame, keep: Callable[[int], bool] | Sequence[int], count: int | None = None) -> DataFrame:
    """Keep whole partitions chosen by id; a predicate needs the number of partitions."""
    if callable(keep):
        require(count is not None, "a predicate on partition ids needs their number")
        keep = [i for i in range(count) if keep(i)]
    return df.filter(F.spark_partition_id().isin(list(keep)))


def map_to_pair(df: DataFrame, key: Column, value: Column, key_type: str, value_type: str) -> DataFrame:
    """A pair dataset with declared types."""
    return df.select(key.cast(key_type).alias("key"), value.cast(value_type).alias("value"))


def map_to_double(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.cast("double").alias("value"))


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*cols(names))
