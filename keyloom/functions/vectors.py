"""Vector arithmetic as Column expressions over ``array<double>``; lengths must match."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checks import as_list
from ..plans.keys import cols, quoted


def vector(value: Column | str | Sequence[float]) -> Column:
    if isinstance(value, Column):
        return value.cast("array<double>")
    if isinstance(value, str):
        return F.col(quoted(value)).cast("array<double>")
    return F.array(*[F.lit(float(v)) for v in value])


def _paired(a, b, f: Callable[[Column, Column], Column]) -> Column:
    left, right = vector(a), vector(b)
    wrong = F.raise_error(F.lit("vectors of different length")).cast("array<double>")
    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("array<double>")).otherwise(
        F.when(F.size(left) == F.size(right), F.zip_with(left, right, f)).otherwise(wrong)
    )


def add(a, b) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def vector_sum(a) -> Column:
    return F.aggregate(vector(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return vector_sum(_paired(a, b, lambda x, y: x * y))


def plus_dot(a, plus, b) -> Column:
    """(a + plus) · b"""
    return dot(add(a, plus), b)


def multiply(a, factor: Column | float) -> Column:
    by = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(vector(a), lambda x: x * by)


def divide(a, divisor: Column | float) -> Column:
    """Division by zero gives infinities, and NaN for a zero element."""
    by = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    quotient = F.transform(vector(a), lambda x: x / F.nullif(by, F.lit(0.0)))
    endless = F.transform(vector(a), lambda x: x * F.lit(float("inf")))
    return F.when(by == 0, endless).otherwise(quotient)


def negate(a) -> Column:
    return F.transform(vector(a), lambda x: -x)


def squared_dist(a, b) -> Column:
    return vector_sum(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def dist(a, b) -> Column:
    return F.sqrt(squared_dist(a, b))


def fill(length: Column | int, f: Callable[[Column], Column]) -> Column:
    """Vector whose element i is f(i)."""
    n = length if isinstance(length, Column) else F.lit(length)
    none = F.array().cast("array<double>")
    indexes = F.sequence(F.lit(0), n.cast("int") - 1)
    return F.when(n > 0, F.transform(indexes, lambda i: f(i).cast("double"))).otherwise(none)


def zeros(length: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), length)


def ones(length: Column | int) -> Column:
    return F.array_repeat(F.lit(1.0), length)


def random(length: int, seed: int) -> Column:
    """Uniform elements in [0, 1), one draw per element."""
    return F.array(*[F.rand(seed + i) for i in range(length)])


def sum_vectors(df: DataFrame, column: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Element-wise sum of all vectors, overall or per key.

    The vectors of a key are added up in each batch, where they lie; elements become rows only
    for these partial sums, one per key and batch. Null vectors and elements add nothing.
    """
    groups = as_list(by)
    source = df.select(*cols(groups), vector(column).alias("__v")).filter(F.col("__v").isNotNull())
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.groupby(groups, dropna=False, sort=False).ngroup() if groups else np.zeros(len(batch), int)
            size = batch["__v"].map(len).to_numpy()
            partial = []
            for n in np.unique(size):  # vectors of different lengths are added by position later
                rows = np.flatnonzero(size == n)
                values = np.stack(batch["__v"].iloc[rows].to_numpy()).astype(float)
                sums = np.zeros((int(np.max(keys)) + 1, n))
                np.add.at(sums, np.asarray(keys)[rows], values)
                first = {}
                for r, k in zip(rows, np.asarray(keys)[rows]):
                    first.setdefault(k, r)
                out = batch.iloc[list(first.values())].copy()
                out["__v"] = [sums[k] for k in first]
                partial.append(out)
            yield pd.concat(partial)

    whole = F.transform("__v", lambda x: F.coalesce(x, F.lit(0.0)))
    sums = (
        source.withColumn("__v", whole).mapInPandas(run, schema)
        .select(*cols(groups), F.posexplode("__v").alias("__i", "__x"))
        .groupBy(*cols(groups), "__i")
        .agg(F.sum("__x").alias("__x"))
    )
    gathered = F.array_sort(F.collect_list(F.struct("__i", "__x")))
    return sums.groupBy(*cols(groups)).agg(
        F.transform(gathered, lambda e: e["__x"]).alias(column)
    )
