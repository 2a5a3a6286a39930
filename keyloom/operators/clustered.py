"""Tables whose files hold ranges or hashes of a key, and readers that open only files that may hold it.

``write_clustered`` writes ``data`` and, beside it, ``index``: for every file the least and the
greatest value of the first key column, its rows without a key, and a Bloom filter of the keys.
A filter is made of slices of 32,768 bits, as many as keep it sparse for the file with the most
rows; a key sets one bit in each of two slices. ``lookup`` and ``filter_by_range`` ask the index,
which is small, and give the reader the files that may hold a match; of those Parquet's own
statistics skip row groups. The rows are those of a plain filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checks import as_list, require, require_columns
from ..plans.keys import all_of, any_of, cols, quoted

SLICE_BITS = 32_768
# Bits a key: with two bits set, about one key in fifty that is not there seems to be.
BITS_PER_KEY = 16
HASHES = 2


def write_clustered(
    df: DataFrame, path: str, keys: str | Sequence[str], files: int | None = None, by: str = "range", append: bool = False
) -> None:
    """Write ``df`` with equal keys side by side: in files of key ranges, or by hash.

    Ranges serve both readers; hashes spread a key that grows, such as a date, over all files.
    ``append`` adds files to a table of the same keys and indexes only those.
    """
    names = as_list(keys)
    require(by in ("range", "hash"), "by is 'range' or 'hash'")
    require_columns(df, names)
    spread = df.repartitionByRange if by == "range" else df.repartition
    placed = spread(files, *cols(names)) if files else spread(*cols(names))
    mode = "append" if append else "errorifexists"
    placed.sortWithinPartitions(*cols(names)).write.mode(mode).parquet(f"{path}/data")
    _index_new_files(df.sparkSession, path, names, append)


def _bits(names: Sequence[str], slices: Column) -> list[Column]:
    """The bits that a key sets, one for each hash, over all slices."""
    total = slices * SLICE_BITS
    return [F.pmod(F.xxhash64(F.lit(i), *cols(names)), total) for i in range(HASHES)]


def _index_new_files(spark: SparkSession, path: str, names: list[str], append: bool) -> None:
    rows = spark.read.parquet(f"{path}/data").select(
        *[F.col(quoted(n)).alias(f"k{i}") for i, n in enumerate(names)], F.col("_metadata.file_name").alias("file")
    )
    if append:
        rows = rows.join(spark.read.parquet(f"{path}/index").select("file"), "file", "left_anti")
    held = [f"k{i}" for i in range(len(names))]
    first = F.col("k0")
    files = rows.groupBy("file").agg(
        F.min(first).alias("least"), F.max(first).alias("greatest"), F.count(F.lit(1)).alias("rows"),
        F.count(F.when(any_of([F.col(h).isNull() for h in held]), 1)).alias("nulls"),
    )
    most = files.agg(F.max("rows")).first()[0] or 1
    slices = max(1, -(-most * BITS_PER_KEY // SLICE_BITS))
    distinct = rows.select("file", *held).distinct()
    bit = distinct.select("file", F.explode(F.array(*_bits(held, F.lit(slices)))).alias("bit"))
    parts = bit.groupBy("file", F.floor(F.col("bit") / SLICE_BITS).cast("int").alias("slice")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("bit"), F.lit(SLICE_BITS))).alias("bits")
    )
    filters = parts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("slice", "bits"))).alias("filter"))
    index = files.join(filters, "file").withColumn("slices", F.lit(slices).cast("long"))
    index.write.mode("append" if append else "errorifexists").parquet(f"{path}/index")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def _read_files(spark: SparkSession, path: str, may_hold: DataFrame) -> DataFrame:
    """The rows of the files of an index; their names go to the reader, as a listing would."""
    whole = read_clustered(spark, path)
    names = [r["file"] for r in may_hold.select("file").collect()]
    if not names:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*[f"{path}/data/{n}" for n in sorted(names)])


def lookup(spark: SparkSession, path: str, keys: str | Sequence[str], key: Any) -> DataFrame:
    """All rows of one key; a null key finds null keys. Only files that may hold it are opened."""
    names = as_list(keys)
    parts = list(key) if isinstance(key, (tuple, list)) else [key]
    require(len(parts) == len(names), "one value per key column is needed")
    kinds = read_clustered(spark, path).select(*cols(names)).schema
    values = [F.lit(v).cast(f.dataType) for v, f in zip(parts, kinds, strict=True)]
    wanted = spark.read.parquet(f"{path}/index").withColumns({f"k{i}": v for i, v in enumerate(values)})
    told = []
    for bit in _bits([f"k{i}" for i in range(len(names))], F.col("slices")):
        bits = F.element_at("filter", F.floor(bit / SLICE_BITS).cast("int"))
        place = F.pmod(bit, F.lit(SLICE_BITS))
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        told.append(F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)))
    first = F.col("k0")
    may_hold = wanted.filter(first.isNull() | first.between(F.col("least"), F.col("greatest"))).filter(all_of(told))
    if any(p is None for p in parts):
        may_hold = may_hold.filter("nulls > 0")
    same = all_of([F.col(quoted(n)).eqNullSafe(v) for n, v in zip(names, values, strict=True)])
    return _read_files(spark, path, may_hold).filter(same)


def filter_by_range(spark: SparkSession, path: str, column: str, lower: Any, upper: Any) -> DataFrame:
    """Rows with ``lower <= column <= upper``, the first key; only files that overlap are opened."""
    kind = read_clustered(spark, path).schema[column].dataType
    low, high = ((v if isinstance(v, Column) else F.lit(v)).cast(kind) for v in (lower, upper))
    index = spark.read.parquet(f"{path}/index")
    may_hold = index.filter((F.col("least") <= high) & (F.col("greatest") >= low))
    return _read_files(spark, path, may_hold).filter(F.col(quoted(column)).between(low, high))
