"""Values shared with tasks: metrics, accumulators, broadcast lookups and files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam, SparkFiles
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def observe(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Aggregates gathered while an action runs over the returned dataset."""
    observation = Observation()
    return df.observe(observation, *[m.alias(n) for n, m in metrics.items()]), observation


def accumulator(spark: SparkSession, start: int | float) -> Accumulator:
    """Add-only number: tasks add, the driver reads. Exact only inside actions."""
    return spark.sparkContext.accumulator(start)


class _Growing(AccumulatorParam):
    """A value that grows by elements or by other values of its kind."""

    def __init__(self, zero: Callable[[], Any], merge: Callable[[Any, Any], Any]) -> None:
        self._zero, self._merge = zero, merge

    def zero(self, value: Any) -> Any:
        return self._zero()

    def addInPlace(self, a: Any, b: Any) -> Any:  # noqa: N802 - name set by the base class
        return self._merge(a, b)


def accumulable(
    spark: SparkSession, zero: Callable[[], Any], merge: Callable[[Any, Any], Any]
) -> Accumulator:
    """Accumulator with a custom merge; tasks add values of the accumulated type."""
    return spark.sparkContext.accumulator(zero(), _Growing(zero, merge))


def _union(a: set, b: Iterable[Any]) -> set:
    a.update(b)
    return a


def accumulable_set(spark: SparkSession) -> Accumulator:
    """Collects distinct values on the driver; add an iterable of them. For few values."""
    return accumulable(spark, set, _union)


def broadcast(spark: SparkSession, value: Any):
    """A read-only value, sent once to every executor."""
    return spark.sparkContext.broadcast(value)


def add_file(spark: SparkSession, path: str, recursive: bool = False) -> None:
    """Send a file to every executor."""
    spark.sparkContext.addFile(path, recursive)


def file_lookup(
    df: DataFrame, file_name: str, key: str, name: str, value_type: str = "string"
) -> DataFrame:
    """Map a column through a shipped file of JSON lines ``{"k": …, "v": …}``.

    Each task reads the file once; keys are compared as text.
    """
    schema = T.StructType([*df.schema, *T.StructType.fromDDL(f"`{name}` {value_type}")])
    kind = to_arrow_schema(schema).field(name).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(file_name), encoding="utf-8") as lines:
            table = {str(item["k"]): item["v"] for item in map(json.loads, lines)}
        for batch in batches:
            keys = batch.column(key).cast(pa.string()).to_pylist()
            yield batch.append_column(name, pa.array([table.get(k) for k in keys], kind))

    return df.mapInArrow(run, schema)
