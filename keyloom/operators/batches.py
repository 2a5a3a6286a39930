"""Aggregation with caller-supplied functions over whole columns, beside the row form of ``combine``.

A function gets the sorted rows of a batch as columns (NumPy arrays where they hold plain numbers
without nulls, Arrow arrays otherwise) and ``starts``, the positions at which a group begins;
it returns a column for each combiner field, with one value a group. ``np.add.reduceat(x, starts)``
is a sum. Partials are merged batch by batch inside a partition, then sorted by key and merged as
a stream, so no group is ever held and Python runs once a batch, not once a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.checks import key_and_values, require
from ..plans.keys import cols
from ..plans.shared import materialise
from ..plans.trees import merge_levels

Columns = Mapping[str, Any]
Function = Callable[[np.ndarray, Columns], Columns]
# Rows of partials a partition may hold before they are merged or passed on.
HELD_ROWS = 100_000


def _column(array: pa.Array) -> Any:
    kind = array.type
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind)
    return array.to_numpy() if plain and array.null_count == 0 else array


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values have equal numbers; nulls are equal, NaN equals NaN, and -0.0 equals 0.0."""
    if pa.types.is_floating(column.type):
        column = pc.add(column, pa.scalar(0.0, column.type))
        # one NaN for all, then apart from null
        column = pc.if_else(pc.is_nan(column), pa.scalar(float("nan"), column.type), column)
    if pa.types.is_nested(column.type):
        column = pa.array([repr(v) for v in column.to_pylist()])
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def group_rows(keys: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows by key, and where in that order a group begins."""
    code = _codes(keys[0]).astype(np.int64)
    for key in keys[1:]:
        other = _codes(key)
        code = np.unique(code * (int(other.max(initial=0)) + 1) + other, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, run_starts(code[order])


def run_starts(code: np.ndarray) -> np.ndarray:
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    return np.flatnonzero(new)


def _applied(f: Function, table: pa.Table, names: Sequence[str], schema: pa.Schema) -> pa.Table:
    """One row per key of the table: the keys, and what ``f`` makes of the rest."""
    if not len(table):
        return schema.empty_table()
    table = table.combine_chunks()
    keys = [_whole(table, n) for n in names]
    if names:
        order, starts = group_rows(keys)
        table = table.take(pa.array(order))
        keys = [k.take(pa.array(order[starts])) for k in keys]
    else:
        starts = np.zeros(1, np.int64)
    made = f(starts, {n: _column(_whole(table, n)) for n in table.column_names if n not in names})
    fields = [f for f in schema if f.name not in names]
    missing = [f.name for f in fields if f.name not in made]
    require(not missing, f"the function gave no column {missing}")
    columns = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in fields]
    require(all(len(c) == len(starts) for c in columns), "the function must give one value a group")
    return pa.Table.from_arrays([*keys, *columns], names=schema.names).cast(schema)


def _whole(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def _merged_partials(
    batches: Iterator[pa.RecordBatch], create: Function, merge: Function, names: Sequence[str], schema: pa.Schema, combine: bool
) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = _applied(create, pa.Table.from_batches([batch]), names, schema)
        if not combine:
            yield part
            continue
        held.append(part)
        rows += len(part)
        if rows > HELD_ROWS:
            both = _applied(merge, pa.concat_tables(held), names, schema)
            if 2 * len(both) > HELD_ROWS:
                yield both
                both = both.slice(0, 0)
            held, rows = [both], len(both)
    if rows:
        yield _applied(merge, pa.concat_tables(held), names, schema)


def combine_batches_by_key(
    df: DataFrame, keys: str | Sequence[str], create: Function, merge: Function, combiner: str, map_side_combine: bool = True
) -> DataFrame:
    """(keys, combiner fields): like ``combine.combine_by_key``, with functions over columns.

    ``create(starts, columns)`` makes combiners of value columns, ``merge(starts, columns)`` fewer
    of combiner columns; it must not matter in which order. ``combiner`` is a DDL string. Null
    keys are one key, and empty input gives no rows.
    """
    names, values = key_and_values(df, keys)
    fields = T.StructType.fromDDL(combiner).fields
    struct = T.StructType([*[T.StructField(n, df.schema[n].dataType) for n in names], *fields])
    schema = to_arrow_schema(struct)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _merged_partials(batches, create, merge, names, schema, map_side_combine):
            yield from table.combine_chunks().to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted, but a group may go on in the next batch: the last one waits
        waiting = schema.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([waiting, pa.Table.from_batches([batch]).cast(schema)]).combine_chunks()
            codes = [_codes(_whole(table, n)) for n in names]
            last = np.flatnonzero(np.any([c != c[-1] for c in codes], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from _applied(merge, table.slice(0, cut), names, schema).combine_chunks().to_batches()
            waiting = _applied(merge, table.slice(cut), names, schema)
        if len(waiting):
            yield from waiting.combine_chunks().to_batches()

    partials = df.select(*cols([*names, *values])).mapInArrow(partial, struct)
    placed = partials.repartition(*cols(names)).sortWithinPartitions(*cols(names))
    return placed.mapInArrow(stream, struct)


def aggregate_batches(df: DataFrame, create: Function, merge: Function, combiner: str, depth: int = 2) -> dict[str, Any] | None:
    """One combiner of all rows as a dict, or None of no rows: ``tree_aggregate`` over columns.

    Each partition becomes one row, and partial results meet on executors, level by level.
    """
    struct = T.StructType.fromDDL(combiner)
    schema = to_arrow_schema(struct)
    placed_struct = T.StructType([T.StructField("__part", T.IntegerType()), *struct.fields])

    def tagged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table):
            part = pa.array(np.full(len(table), TaskContext.get().partitionId(), np.int32))
            yield from table.add_column(0, "__part", part).combine_chunks().to_batches()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in batches:
            if batch.num_rows:
                part = _applied(create, pa.Table.from_batches([batch]), [], schema)
                held = _applied(merge, pa.concat_tables([held, part]), [], schema) if len(held) else part
        yield from tagged(held)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in batches:
            if batch.num_rows:
                part = pa.Table.from_batches([batch]).drop_columns("__part").cast(schema)
                held = _applied(merge, pa.concat_tables([held, part]), [], schema)
        yield from tagged(held)

    merge_levels(1, depth)
    table = materialise(df.mapInArrow(partial, placed_struct), "partials")
    for size in merge_levels(table.count(), depth):
        table = table.repartition(size, F.pmod("__part", F.lit(size))).mapInArrow(level, placed_struct)
    left = table.drop("__part").toArrow()
    if not len(left):
        return None
    return _applied(merge, left.cast(schema), [], schema).to_pylist()[0]
