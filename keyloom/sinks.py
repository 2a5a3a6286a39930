"""Writing datasets. Every sink refuses to overwrite unless asked to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .plans.checks import require


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def save_as_text(
    df: DataFrame,
    path: str,
    line: Column | None = None,
    compression: str | None = None,
    overwrite: bool = False,
) -> None:
    """One line per row: ``line`` if given, else the row as a JSON object."""
    text = F.to_json(F.struct("*")) if line is None else line.cast("string")
    df.select(text.alias("value")).write.mode(_mode(overwrite)).text(path, compression=compression)


def save_as_object(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Typed, lossless columnar files; ``sources.object_file`` reads them."""
    df.write.mode(_mode(overwrite)).parquet(path)


def _pairs(df: DataFrame):
    require(len(df.columns) == 2, "a pair dataset has exactly two columns")
    return df.rdd.map(tuple)


def save_as_sequence(df: DataFrame, path: str, codec: str | None = None) -> None:
    """Write a two-column dataset as SequenceFiles; writables follow the column types."""
    _pairs(df).saveAsSequenceFile(path, codec)


def save_as_hadoop_file(
    df: DataFrame, path: str, output_format: str, key_class: str | None = None,
    value_class: str | None = None, conf: Mapping[str, str] | None = None, codec: str | None = None,
) -> None:
    """Write pairs with an OutputFormat of the old (``mapred``) API."""
    _pairs(df).saveAsHadoopFile(
        path, output_format, keyClass=key_class, valueClass=value_class,
        conf=dict(conf or {}), compressionCodecClass=codec,
    )


def save_as_hadoop_dataset(df: DataFrame, conf: Mapping[str, str]) -> None:
    _pairs(df).saveAsHadoopDataset(dict(conf))


def save_as_new_hadoop_file(
    df: DataFrame, path: str, output_format: str, key_class: str | None = None,
    value_class: str | None = None, conf: Mapping[str, str] | None = None,
) -> None:
    """Write pairs with an OutputFormat of the new (``mapreduce``) API."""
    _pairs(df).saveAsNewAPIHadoopFile(
        path, output_format, keyClass=key_class, valueClass=value_class, conf=dict(conf or {})
    )


def save_as_new_hadoop_dataset(df: DataFrame, conf: Mapping[str, str]) -> None:
    _pairs(df).saveAsNewAPIHadoopDataset(dict(conf))


def foreach(df: DataFrame, effect: Callable[[Row], None]) -> None:
    """Run an effect for every row on the executors."""
    df.foreach(effect)


def foreach_partition(df: DataFrame, effect: Callable[[Iterable[Row]], None]) -> None:
    """Run an effect once per partition; retried tasks run it again."""
    df.foreachPartition(effect)


def foreach_batch(stream: DataFrame, effect: Callable[[DataFrame, int], Any], checkpoint: str):
    """Run an effect for every micro-batch of a stream that reads what is available now."""
    return (
        stream.writeStream.foreachBatch(effect)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
