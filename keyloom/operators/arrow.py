"""Helpers to run caller-supplied Python code on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 10_000


def as_struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _values(column: pa.Array) -> list[Any]:
    """The column as Python values; plain numbers and texts take the fast way through numpy."""
    kind = column.type
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)
    if pa.types.is_string(kind) or (plain and column.null_count == 0):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*[_values(c) for c in batch.columns], strict=True):
            yield dict(zip(names, values, strict=True))


def batches_of(
    rows: Iterable[dict[str, Any] | Sequence[Any]], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Group rows (dicts, or sequences in field order) into Arrow batches."""
    names = schema.names
    pending: list[dict[str, Any]] = []
    for row in rows:
        pending.append(row if isinstance(row, dict) else dict(zip(names, row, strict=True)))
        if len(pending) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)
            pending = []
    if pending:
        yield pa.RecordBatch.from_pylist(pending, schema=schema)


def map_row_iterator(
    df: DataFrame,
    f: Callable[[Iterator[dict[str, Any]]], Iterable[dict[str, Any] | Sequence[Any]]],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply ``f`` to the row iterator of each partition, Arrow in and Arrow out."""
    struct = as_struct(schema)
    arrow_schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(f(rows_of(batches)), arrow_schema)

    return df.mapInArrow(run, struct)
