"""Finding and splitting keys that hold too many rows for one task.

A hot key is split by the position of its rows in a written table. A position stays the same
however often a task is run again, and it spreads rows that lie in one partition, or are equal,
as evenly as any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import cols, match, prefixed, quoted
from .prefix import FILE, ROW, numbered_files
from .shared import materialise

# Rows one task may hold for one key before the key is split.
ROWS_PER_TASK = 1_000_000
# Largest table this library will broadcast, in rows and in bytes, both measured before.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

PART = "__part"
PARTS = "__parts"


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring that the table is within both bounds.

    Bytes are those of the rows as text, twice over. Beyond a bound no hint is given and the
    join shuffles.
    """
    size = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    seen = df.select(size.alias("n")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("n")).first()
    return F.broadcast(df) if seen[0] <= max_rows and 2 * (seen[1] or 0) <= max_bytes else df


def hot_groups(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame | None:
    """Keys with more than ``rows_per_task`` rows and the number of parts each needs.

    One pass over the key columns, combined before the shuffle. The table is written once,
    so every later use sees the same answer. ``None`` when no key is hot.
    """
    counts = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("__n"))
    return hot_from_counts(counts, keys, "__n", rows_per_task)


def hot_from_counts(
    counts: DataFrame, keys: Sequence[str], count: str, rows_per_task: int
) -> DataFrame | None:
    """``hot_groups`` from a table that already has the number of rows of every key."""
    n = F.col(quoted(count))
    hot = counts.filter(n > rows_per_task).select(
        *cols(keys), F.ceil(n / rows_per_task).cast("int").alias(PARTS)
    )
    table = materialise(hot, "hot")
    if table.isEmpty():
        return None
    return broadcast_if_small(table)


def with_parts(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None, parts_name: str = PARTS
) -> DataFrame:
    """Add the number of parts of each row's key (1 when the key is not hot)."""
    if hot is None:
        return df.withColumn(parts_name, F.lit(1))
    side = prefixed(hot.withColumnRenamed(PARTS, "__hot_parts"), keys, "__hot_")
    hot_keys = ["__hot_" + k for k in keys]
    joined = df.join(side, match(keys, hot_keys), "left")
    return joined.withColumn(parts_name, F.coalesce(F.col("__hot_parts"), F.lit(1))).drop(
        *hot_keys, "__hot_parts"
    )


def numbered(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` written once, and a number that spreads its rows: a hash of their position."""
    return numbered_files(df), F.xxhash64(FILE, ROW)


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """Add column ``__part``: 0 for ordinary keys, 0…parts-1 for rows of a hot key."""
    if hot is None:
        return df.withColumn(PART, F.lit(0))
    table, place = numbered(df)
    return (
        with_parts(table, keys, hot)
        .withColumn(PART, F.pmod(place, F.col(PARTS)).cast("int"))
        .drop(FILE, ROW, PARTS)
    )


def group_in_chunks(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], rows_per_chunk: int
) -> DataFrame:
    """(keys, chunk, aggregates…): a key of n rows in ceil(n / rows_per_chunk) chunks of about that size."""
    hot = hot_groups(df.select(*cols(keys)), keys, rows_per_chunk)
    return split_hot(df, keys, hot).groupBy(*cols(keys), F.col(PART).alias("chunk")).agg(*aggregates)
