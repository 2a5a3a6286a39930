"""Sorts, limits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..plans.checks import as_list, require
from ..plans.keys import cols
from .aggregates import first_or_error


def _directed(columns: Sequence[Column], ascending: bool) -> list[Column]:
    return [c.asc() if ascending else c.desc() for c in columns]


def sort_by_key(
    df: DataFrame, keys: str | Sequence[str], ascending: bool = True, num_partitions: int | None = None
) -> DataFrame:
    """Total order over range partitions; ``num_partitions`` fixes their number."""
    return sort_by(df, cols(as_list(keys)), ascending, num_partitions)


def sort_by(
    df: DataFrame, by: Column | Sequence[Column], ascending: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Total order by computed keys."""
    order = _directed([by] if isinstance(by, Column) else list(by), ascending)
    if num_partitions is None:
        return df.orderBy(*order)
    return df.repartitionByRange(num_partitions, *order).sortWithinPartitions(*order)


def repartition_and_sort_within_partitions(
    df: DataFrame, keys: str | Sequence[str], num_partitions: int | None = None,
    sort_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Hash-partition by key and sort inside each partition."""
    key_cols = cols(as_list(keys))
    placed = df.repartition(num_partitions, *key_cols) if num_partitions else df.repartition(*key_cols)
    return placed.sortWithinPartitions(*(cols(as_list(sort_by)) or key_cols))


def take(df: DataFrame, n: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first n rows; without an order, any n rows from as few partitions as needed."""
    require(n >= 0, "n must not be negative")
    return take_ordered(df, n, order_by) if order_by else df.limit(n)


def first(df: DataFrame, order_by: str | Sequence[str] | None = None):
    """The first row; empty input raises."""
    return first_or_error(take(df, 1, order_by))


def top(df: DataFrame, n: int, by: str | Sequence[str] | Column) -> DataFrame:
    """The n largest rows, descending: a bounded heap per partition."""
    return _bounded(df, n, by, ascending=False)


def take_ordered(df: DataFrame, n: int, by: str | Sequence[str] | Column) -> DataFrame:
    """The n smallest rows, ascending."""
    return _bounded(df, n, by, ascending=True)


def _bounded(df: DataFrame, n: int, by: str | Sequence[str] | Column, ascending: bool) -> DataFrame:
    require(n >= 0, "n must not be negative")
    columns = [by] if isinstance(by, Column) else cols(as_list(by))
    return df.orderBy(*_directed(columns, ascending)).limit(n)


