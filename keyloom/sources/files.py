"""Text, whole-file, binary and typed file sources. Paths are any Hadoop URIs or globs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .listing import list_files


def _paths(paths: str | Sequence[str]) -> list[str]:
    """A comma-separated string lists several paths."""
    return [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)


def text_file(spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None) -> DataFrame:
    """One row per line in column ``value``; compressed files are read by extension."""
    options = {} if line_sep is None else {"lineSep": line_sep}
    return spark.read.options(**options).text(_paths(paths))


def text_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The lines of files as they arrive in a folder, as a streaming DataFrame."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def _empty_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Paths of files without content, which Spark's readers leave out; listed in tasks, by folder."""
    return list_files(spark, paths).filter("length = 0").select("path")


def whole_text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, content) with the full text of each file; an empty file has the empty text."""
    listed = _paths(paths)
    # file_path is URL-encoded, but a plus sign in it is a plus sign
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    texts = spark.read.text(listed, wholetext=True).select(
        path.alias("path"), F.col("value").alias("content")
    )
    empty = _empty_files(spark, listed).select("path", F.lit("").alias("content"))
    return texts.unionByName(empty)


def binary_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, length, content) per file; the content is read only when the column is used."""
    listed = _paths(paths)
    files = spark.read.format("binaryFile").load(listed).select("path", "length", "content")
    empty = _empty_files(spark, listed).select(
        "path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")
    )
    return files.unionByName(empty)


def object_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed, lossless read of what ``sinks.save_as_object`` wrote."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def input_splits(df: DataFrame) -> DataFrame:
    """Add the file split each row was read from: path, start and length."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("split_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("_metadata.file_block_length").alias("split_length"),
    )
