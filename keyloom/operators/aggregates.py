"""Exact aggregates built from Spark's own: partial sums before every shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import EmptyInputError, as_list, key_and_values, require, require_columns
from ..plans.keys import cols, quoted
from ..plans.skew import ROWS_PER_TASK, group_in_chunks

NAN = float("nan")


def aggregate_columns(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of named aggregates over the whole dataset."""
    return df.agg(*[a.alias(n) for n, a in aggregates.items()])


def reduce_columns(df: DataFrame, **aggregates: Column) -> DataFrame:
    """As ``aggregate_columns``, but an empty dataset is an error, raised when evaluated."""
    return (
        df.agg(F.count(F.lit(1)).alias("__n"), *[a.alias(n) for n, a in aggregates.items()])
        .filter(
            F.when(F.col("__n") > 0, True).otherwise(
                F.raise_error(F.lit("empty collection")).cast("boolean")
            )
        )
        .drop("__n")
    )


def count_rows(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def count_by_value(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Distinct rows with their counts."""
    names = as_list(columns) or df.columns
    return df.groupBy(*cols(names)).agg(F.count(F.lit(1)).alias("count"))


def max_min(df: DataFrame, column: str, order: Column | None = None) -> DataFrame:
    """(max, min) of a column, by natural order or by an ordering key; empty raises."""
    c = F.col(quoted(column))
    if order is None:
        return reduce_columns(df, max=F.max(c), min=F.min(c))
    return reduce_columns(df, max=F.max_by(c, order), min=F.min_by(c, order))


def reduce_by_key(df: DataFrame, keys: str | Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates per key, combined before the shuffle; null is a key."""
    names = as_list(keys)
    require_columns(df, names)
    return df.groupBy(*cols(names)).agg(*[a.alias(n) for n, a in aggregates.items()])


def fold_by_key(
    df: DataFrame, keys: str | Sequence[str], column: str, zero: Any, how: str = "sum"
) -> DataFrame:
    """Fold the values of each key with a neutral ``zero``; null values count as zero."""
    functions = {"sum": F.sum, "max": F.max, "min": F.min}
    require(how in functions, f"how is one of {sorted(functions)}")
    value = F.coalesce(F.col(quoted(column)), F.lit(zero))
    return reduce_by_key(df, keys, **{column: functions[how](value)})


def count_by_key(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return reduce_by_key(df, keys, count=F.count(F.lit(1)))


def as_map(df: DataFrame, keys: str | Sequence[str], value: str) -> dict[Any, Any]:
    """A by-key result as a dict on the driver. Only for results known to be small."""
    names = as_list(keys)
    rows = df.select(*cols([*names, value])).toLocalIterator()
    if len(names) == 1:
        return {row[0]: row[1] for row in rows}
    return {tuple(row[:-1]): row[-1] for row in rows}


def reduce_by_key_locally(
    df: DataFrame, keys: str | Sequence[str], aggregate: Column
) -> dict[Any, Any]:
    return as_map(reduce_by_key(df, keys, value=aggregate), keys, "value")


def collect_as_map(
    df: DataFrame, keys: str | Sequence[str], value: str, order_by: Column | str
) -> DataFrame:
    """One value per key: the last in the declared order."""
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    return reduce_by_key(df, keys, **{value: F.max_by(F.col(quoted(value)), order)})


def _packed(df: DataFrame, keys: str | Sequence[str], name: str) -> tuple[DataFrame, list[str]]:
    key_names, values = key_and_values(df, keys)
    return df.select(*cols(key_names), F.struct(*cols(values)).alias(name)), key_names


def group_by_key(df: DataFrame, keys: str | Sequence[str], name: str = "values") -> DataFrame:
    """(keys, values): the value structs of each key as one array, in no order.

    Always one row per key, so a key's values must fit in a row. ``group_by_key_chunks`` is
    for keys that have more.
    """
    packed, key_names = _packed(df, keys, name)
    return packed.groupBy(*cols(key_names)).agg(F.collect_list(name).alias(name))


def group_by_key_chunks(
    df: DataFrame,
    keys: str | Sequence[str],
    name: str = "values",
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """(keys, chunk, values): every key in numbered chunks of about ``rows_per_chunk`` rows.

    Each value is in exactly one chunk, and no task holds more than a chunk.
    """
    packed, key_names = _packed(df, keys, name)
    return group_in_chunks(packed, key_names, [F.collect_list(name).alias(name)], rows_per_chunk)


def group_by(df: DataFrame, key: Column, name: str = "values") -> DataFrame:
    """``group_by_key`` on a computed key; whole rows are the values."""
    return group_by_key(df.select(key.alias("key"), "*"), "key", name)


def sum_double(df: DataFrame, column: str) -> DataFrame:
    """Sum as double; 0.0 for an empty dataset."""
    total = F.sum(F.col(quoted(column)).cast("double"))
    return df.agg(F.coalesce(total, F.lit(0.0)).alias("sum"))


def stats_columns(column: str) -> dict[str, Column]:
    """count, mean, sum, max, min and the variances, with the values defined for no rows."""
    x = F.col(quoted(column)).cast("double")
    n = F.count(x)

    def at_least(rows: int, value: Column) -> Column:
        return F.when(n >= rows, value).otherwise(F.lit(NAN))

    return {
        "count": n,
        "mean": F.coalesce(F.avg(x), F.lit(0.0)),
        "sum": F.coalesce(F.sum(x), F.lit(0.0)),
        "max": F.coalesce(F.max(x), F.lit(-math.inf)),
        "min": F.coalesce(F.min(x), F.lit(math.inf)),
        "variance": at_least(1, F.var_pop(x)),
        "sample_variance": at_least(2, F.var_samp(x)),
        "stdev": at_least(1, F.stddev_pop(x)),
        "sample_stdev": at_least(2, F.stddev_samp(x)),
    }


def stats(df: DataFrame, column: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Running statistics of a numeric column in one pass, overall or per group."""
    aggregates = [c.alias(n) for n, c in stats_columns(column).items()]
    return df.groupBy(*cols(as_list(by))).agg(*aggregates) if by else df.agg(*aggregates)


def variance_family(df: DataFrame, column: str) -> DataFrame:
    return stats(df, column).select(
        "mean", "variance", "stdev", "sample_stdev", "sample_variance"
    )


def first_or_error(df: DataFrame) -> Any:
    row = df.first()
    if row is None:
        raise EmptyInputError("empty collection")
    return row

