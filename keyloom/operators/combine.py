"""Aggregation with caller-supplied Python functions.

Each partition is reduced where it lies; only partial results move. By-key partials are
sorted by key inside their partition and merged as a stream, so no key is ever collected
into memory as a group.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence
from functools import reduce as fold_left
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checks import EmptyInputError, key_and_values, require_columns
from ..plans.keys import cols
from ..plans.shared import materialise
from ..plans.trees import merge_levels
from .arrow import map_row_iterator

# Distinct keys a map-side table may hold before its partials are passed on.
MAP_SIDE_KEYS = 100_000


def _merge_partials(
    partials: DataFrame, combine: Callable[[Any, Any], Any], depth: int
) -> list[Any]:
    """Merge one value per partition level by level; return the few that remain."""
    table = materialise(partials, "partials")
    value_type = table.schema["value"].dataType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("value", value_type)]
    )
    for size in merge_levels(table.count(), depth):

        def merge(rows: Iterator[dict[str, Any]], size: int = size) -> Iterator[Any]:
            merged: dict[int, Any] = {}
            for row in rows:
                slot = row["part"] % size
                value = row["value"]
                merged[slot] = combine(merged[slot], value) if slot in merged else value
            return iter(merged.items())

        placed = table.repartition(size, F.pmod("part", F.lit(size)))
        table = map_row_iterator(placed, merge, schema)
    return [row["value"] for row in table.select("value").collect()]


def _partials(
    df: DataFrame,
    column: str | None,
    start: Callable[[Iterator[Any]], list[Any]],
    value_type: T.DataType,
) -> DataFrame:
    """One partial value per partition (or none), computed on the row iterator."""
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("value", value_type)]
    )

    def run(rows: Iterator[dict[str, Any]]) -> Iterator[Any]:
        items = (row[column] for row in rows) if column else rows
        part = TaskContext.get().partitionId()
        for value in start(items):
            yield part, value

    source = df.select(*cols([column])) if column else df
    return map_row_iterator(source, run, schema)


def tree_reduce(
    df: DataFrame, column: str, f: Callable[[Any, Any], Any], depth: int = 2
) -> Any:
    """Reduce a column with an associative, commutative function; empty input raises."""
    require_columns(df, [column])

    def start(items: Iterator[Any]) -> list[Any]:
        first = next(items, _NOTHING)
        return [] if first is _NOTHING else [fold_left(f, items, first)]

    merge_levels(1, depth)
    partials = _partials(df, column, start, df.schema[column].dataType)
    left = _merge_partials(partials, f, depth)
    if not left:
        raise EmptyInputError("empty collection")
    return fold_left(f, left)


def reduce(df: DataFrame, column: str, f: Callable[[Any, Any], Any]) -> Any:
    """``tree_reduce``: partial results meet on executors before the driver sees them."""
    return tree_reduce(df, column, f)


def tree_aggregate(
    df: DataFrame,
    zero: Any,
    seq: Callable[[Any, Any], Any],
    combine: Callable[[Any, Any], Any],
    result_type: T.DataType | str,
    column: str | None = None,
    depth: int = 2,
) -> Any:
    """Fold rows (dicts, or the values of one column) into a value of another type.

    ``zero`` is used once per partition and must be neutral. Empty input gives ``zero``.
    """
    merge_levels(1, depth)
    if isinstance(result_type, str):
        result_type = T.StructType.fromDDL(f"value {result_type}")["value"].dataType

    def start(items: Iterator[Any]) -> list[Any]:
        return [fold_left(seq, items, copy.deepcopy(zero))]

    values = _merge_partials(_partials(df, column, start, result_type), combine, depth)
    return fold_left(combine, [_plain(v) for v in values], copy.deepcopy(zero))


def aggregate(df, zero, seq, combine, result_type, column=None) -> Any:
    """``tree_aggregate``: partial results meet on executors before the driver sees them."""
    return tree_aggregate(df, zero, seq, combine, result_type, column)


def fold(df: DataFrame, column: str, zero: Any, op: Callable[[Any, Any], Any]) -> Any:
    """Fold a column; ``zero`` is used once per partition and once in the merge."""
    return aggregate(df, zero, op, op, df.schema[column].dataType, column)


def combine_by_key(
    df: DataFrame,
    keys: str | Sequence[str],
    create: Callable[[dict[str, Any]], Any],
    merge_value: Callable[[Any, dict[str, Any]], Any],
    merge_combiners: Callable[[Any, Any], Any],
    combiner_type: T.DataType | str,
    map_side_combine: bool = True,
) -> DataFrame:
    """(keys, value): combine the rows of each key with three Python functions.

    ``create`` and ``merge_value`` see the value columns of a row as a dict.
    """
    names, values = key_and_values(df, keys)
    if isinstance(combiner_type, str):
        combiner_type = T.StructType.fromDDL(f"value {combiner_type}")["value"].dataType
    schema = T.StructType(
        [df.schema[n] for n in names] + [T.StructField("value", combiner_type)]
    )

    def partial(rows: Iterator[dict[str, Any]]) -> Iterator[Any]:
        table: dict[Any, tuple[list[Any], Any]] = {}
        for row in rows:
            key = [row[n] for n in names]
            value = {v: row[v] for v in values}
            slot = _hashable(key)
            if slot in table:
                table[slot] = (key, merge_value(table[slot][1], value))
            else:
                table[slot] = (key, create(value))
            if len(table) >= (MAP_SIDE_KEYS if map_side_combine else 1):
                yield from ([*k, c] for k, c in table.values())
                table = {}
        yield from ([*k, c] for k, c in table.values())

    def merge(rows: Iterator[dict[str, Any]]) -> Iterator[Any]:
        current, slot, combined = None, None, None
        for row in rows:
            key = [row[n] for n in names]
            here = _hashable(key)
            if current is not None and here == slot:
                combined = merge_combiners(combined, row["value"])
                continue
            if current is not None:
                yield [*current, combined]
            current, slot, combined = key, here, row["value"]
        if current is not None:
            yield [*current, combined]

    partials = map_row_iterator(df.select(*cols([*names, *values])), partial, schema)
    placed = partials.repartition(*cols(names)).sortWithinPartitions(*cols(names))
    return map_row_iterator(placed, merge, schema)


def aggregate_by_key(
    df: DataFrame,
    keys: str | Sequence[str],
    zero: Any,
    seq: Callable[[Any, dict[str, Any]], Any],
    combine: Callable[[Any, Any], Any],
    result_type: T.DataType | str,
) -> DataFrame:
    """``combine_by_key`` starting from a fresh ``zero`` for each key in each partition."""
    return combine_by_key(
        df, keys, lambda v: seq(copy.deepcopy(zero), v), seq, combine, result_type
    )


class _Nothing:
    pass


_NOTHING = _Nothing()


def _hashable(value: Any) -> Any:
    if isinstance(value, (list, tuple)):
        return tuple(_hashable(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _hashable(v)) for k, v in value.items())
    if isinstance(value, float) and value != value:
        return "NaN", float  # NaN equals NaN as a key
    return value


def _plain(value: Any) -> Any:
    """Rows that come back from Spark as the dicts user functions work on."""
    return value.asDict(recursive=True) if isinstance(value, Row) else value


__all__ = [
    "aggregate",
    "aggregate_by_key",
    "combine_by_key",
    "fold",
    "reduce",
    "tree_aggregate",
    "tree_reduce",
]
