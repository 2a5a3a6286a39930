"""Python functions as scalar, aggregate and table functions, Arrow-batched.

Column expressions are preferred; these wrap code that cannot be written as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.checks import key_and_values
from ..plans.keys import cols, quoted

SLICE_BYTES = 1 << 20


def scalar(f: Callable[..., pd.Series], return_type: str) -> Callable[..., Column]:
    """One output value per row from one or more columns, a batch at a time."""
    return F.pandas_udf(f, return_type)


def scalar_arrow(f: Callable[..., Any], return_type: str) -> Callable[..., Column]:
    """As ``scalar`` on Arrow arrays, without the pandas conversion."""
    return F.arrow_udf(f, return_type)


def reduce_groups(
    df: DataFrame, keys: str | Sequence[str], column: str,
    f: Callable[[pd.Series], Any], return_type: str,
) -> DataFrame:
    """(keys, column): group to value with any pandas function of the whole group.

    A group is handed over whole, so it must fit in a task. ``merge_groups`` is for functions
    that can work in parts. Numbers of a key are packed where they lie, so the shuffle and its sort
    hold 8 bytes for each of them at most instead of a row.
    """
    names, _ = key_and_values(df, keys)
    kind = df.schema[column].dataType
    numbers = isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)
    packed = numbers and column not in names and all(isinstance(df.schema[n].dataType, T.AtomicType) for n in names)

    def whole(values: pd.Series) -> Any:
        return f(_unpacked(values) if packed else values)

    whole.__annotations__ = {"values": pd.Series, "return": float}
    reducer = F.pandas_udf(whole, return_type, F.PandasUDFType.GROUPED_AGG)
    source = _pack(df, names, column) if packed else df
    return source.groupBy(*cols(names)).agg(reducer(F.col(quoted(column))).alias(column))


def _pack(df: DataFrame, names: Sequence[str], column: str) -> DataFrame:
    """(keys…, column): the numbers of a key in one batch of rows as an array, in the order of the rows."""
    struct = T.StructType([*[df.schema[n] for n in names], T.StructField(column, T.ArrayType(df.schema[column].dataType))])
    schema = to_arrow_schema(struct)
    count = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = _group_numbers(batch, count)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            offsets = pa.array(np.append(first, len(order)), pa.int32())
            values = pa.ListArray.from_arrays(offsets, batch.column(count).take(pa.array(order)))
            kept = [batch.column(i).take(pa.array(order[first])) for i in range(count)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip([*kept, values], schema, strict=True)], schema=schema)

    return df.select(*cols([*names, column])).mapInArrow(run, struct)


def _group_numbers(batch: pa.RecordBatch, count: int) -> np.ndarray:
    """A number for each row of a batch, equal where the first ``count`` columns are."""
    number = np.zeros(batch.num_rows, dtype=np.int64)
    for i in range(count):
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        number = np.unique(number * batch.num_rows + codes, return_inverse=True)[1]
    return number


def _unpacked(arrays: pd.Series) -> pd.Series:
    parts = arrays.to_numpy()
    whole = parts[0].base
    if isinstance(whole, np.ndarray) and whole.size == sum(p.size for p in parts) and all(p.base is whole for p in parts):
        return pd.Series(whole.reshape(-1))  # Arrow gives the arrays as consecutive parts of one
    return pd.Series(np.concatenate(parts))


def merge_groups(
    df: DataFrame, keys: str | Sequence[str], column: str,
    partial: Callable[[pd.Series], Any], merge: Callable[[pd.Series], Any], return_type: str,
) -> DataFrame:
    """(keys, column): group to value in two stages, at every size.

    ``partial`` sees the values of a key in one batch of rows, where they lie; ``merge`` sees
    a key's partial results. Only those are shuffled. ``merge`` must not depend on how the
    rows were batched.
    """
    names, _ = key_and_values(df, keys)
    source = df.select(*cols([*names, column]))
    value = T.StructType.fromDDL(f"value {return_type}")["value"].dataType
    schema = T.StructType([*[df.schema[n] for n in names], T.StructField(column, value)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grouped = batch.groupby(names, dropna=False, sort=False)[column]
            rows = [(*(k if isinstance(k, tuple) else (k,)), partial(v)) for k, v in grouped]
            frame = pd.DataFrame(rows, columns=[*names, column])
            yield frame.astype({n: batch[n].dtype for n in names})

    return reduce_groups(source.mapInPandas(run, schema), names, column, merge, return_type)


def table_function(
    df: DataFrame, f: Callable[[Any], Iterable[tuple]], column: str, return_type: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows out of each value of a column, through a Python table function."""

    class Rows:
        def eval(self, value: Any):
            yield from f(value)

    function = F.udtf(Rows, returnType=return_type)
    return df.select(*cols([*keep, *([] if column in keep else [column])])).lateralJoin(
        function(F.col(quoted(column)).outer())
    ).drop(*([] if column in keep else [column]))


def table_function_batches(
    df: DataFrame, f: Callable[[pa.Array], tuple[Any, Sequence[Any]]], column: str, return_type: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows out of the values of a column, a batch at a time: ``table_function`` over Arrow arrays.

    ``f`` gives, for an array of values, the position in it that each new row comes from, and the
    new columns in the order of ``return_type``. A value may give no row or many. It gets as many
    values at a time as have about ``SLICE_BYTES``, so what they give stays small, however large a batch is.
    """
    made = T.StructType.fromDDL(return_type)
    struct = T.StructType([*[df.schema[k] for k in keep], *made.fields])
    schema = to_arrow_schema(struct)
    names = [*keep, *([] if column in keep else [column])]
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, at)):
            parents, columns = f(batch.column(at))
            parents = pa.array(parents)
            kept = [batch.column(i).take(parents) for i in range(len(keep))]
            own = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            arrays = [c.cast(t.type) for c, t in zip([*kept, *own], schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(*cols(names)).mapInArrow(run, struct)


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with about ``SLICE_BYTES`` in one column, a row at least."""
    rows = batch.num_rows
    if rows == 0 or batch.column(at).nbytes <= SLICE_BYTES:
        yield batch
        return
    start = 0
    while start < rows:
        length = rows - start
        while length > 1 and batch.column(at).slice(start, length).nbytes > SLICE_BYTES:
            length = (length + 1) // 2
        yield batch.slice(start, length)
        start += length


def map_groups(
    df: DataFrame, keys: str | Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Rows out of each group, which is handed over whole and must fit in a task."""
    names, _ = key_and_values(df, keys)
    return df.groupBy(*cols(names)).applyInPandas(f, schema)


def map_groups_arrow(
    df: DataFrame, keys: str | Sequence[str], f: Callable[[pa.Table], pa.Table], schema: T.StructType | str
) -> DataFrame:
    """``map_groups`` over Arrow tables, without the cost of a pandas frame for every group."""
    names, _ = key_and_values(df, keys)
    return df.groupBy(*cols(names)).applyInArrow(f, schema)


def co_map_groups(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str],
    f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
) -> DataFrame:
    """Rows out of the groups two datasets have under one key; both are handed over whole."""
    names, _ = key_and_values(left, keys)
    return (
        left.groupBy(*cols(names)).cogroup(right.groupBy(*cols(names))).applyInPandas(f, schema)
    )
