"""Where rows live: partition counts, hash, range and custom placement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import as_list, require, require_columns
from ..plans.keys import cols, quoted
from ..plans.prefix import running
from ..plans.shared import materialise
from .bucketed import layout_of


def repartition(df: DataFrame, n: int) -> DataFrame:
    """Spread rows evenly over n partitions (full shuffle)."""
    require(n >= 1, "n must be positive")
    return df.repartition(n)


def coalesce(df: DataFrame, n: int, shuffle: bool = False) -> DataFrame:
    """Merge neighbouring partitions; growing their number needs a shuffle."""
    require(n >= 1, "n must be positive")
    return df.repartition(n) if shuffle else df.coalesce(n)


def hash_partition(df: DataFrame, keys: str | Sequence[str], n: int | None = None) -> DataFrame:
    """Equal keys share a partition; a null key is a key. Rows placed so already stay where they are."""
    names = as_list(keys)
    if n and layout_of(df) == (names, n):
        return df
    key_cols = cols(names)
    return df.repartition(n, *key_cols) if n else df.repartition(*key_cols)


def range_partition(
    df: DataFrame, keys: str | Sequence[str], n: int | None = None, ascending: bool = True
) -> DataFrame:
    """Partitions are consecutive ranges of the key; Spark samples the bounds."""
    order = [c.asc() if ascending else c.desc() for c in cols(as_list(keys))]
    return df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)


def custom_partition(df: DataFrame, n: int, partition: Column) -> DataFrame:
    """Place each row in the partition an expression computes; the id is taken modulo n."""
    require(n >= 1, "n must be positive")
    return df.repartitionById(n, F.pmod(partition.cast("int"), F.lit(n)))


def range_bounds(
    df: DataFrame, key: str, n: int, fraction: float | None = None, seed: int = 0
) -> DataFrame:
    """(bound, key): up to n-1 distinct upper bounds that cut the rows into n even ranges.

    Bound j is the first key, above bound j-1, whose running weight reaches j/n of the
    total. All rows count and the result is exact, unless the caller gives the ``fraction`` of
    rows to sample.
    """
    require(n >= 1, "n must be positive")
    require_columns(df, [key])
    source = df.select(F.col(quoted(key)).alias("key")).filter(F.col("key").isNotNull())
    if fraction is not None:
        source = source.sample(False, fraction, seed)
    weights = source.groupBy("key").agg(F.count(F.lit(1)).alias("__w"))
    return _cut(weights, n)


def range_bounds_sketched(df: DataFrame, key: str, n: int, per_range: int = 20, seed: int = 0) -> DataFrame:
    """(bound, key): like ``range_bounds``, from a weighted sketch of the partitions in one pass.

    Each partition gives a uniform sample of at most ``3 * per_range * n / partitions`` keys and
    its number of rows; a sampled key stands for that many rows each. A partition with far more
    rows than the others is sampled again, at the rate that the whole sample was meant to have.
    The sketch has about ``per_range * n`` keys however many rows there are. The input must have
    the same partitions when it is read again, as a table has; null keys take no part.
    """
    require(n >= 1 and per_range >= 1, "n and per_range must be positive")
    require_columns(df, [key])
    source = df.select(F.col(quoted(key)).alias("key"))
    partitions = max(1, source.rdd.getNumPartitions())
    size = per_range * n
    most = -(-3 * size // partitions)
    sketch = materialise(_partition_samples(source, most, seed), "sketch")
    counts = {r["part"]: r["n"] for r in sketch.groupBy("part").agg(F.max("n").alias("n")).collect()}  # a row a partition
    total = sum(counts.values())
    rate = min(1.0, size / total) if total else 1.0
    skewed = [part for part, rows in counts.items() if rows * rate > most]
    even = sketch.filter(~F.col("part").isin(skewed)) if skewed else sketch
    # whole numbers, so that weights add up the same in any order
    weight = F.round(F.lit(1000.0) * F.col("n") / F.least(F.col("n"), F.lit(most))).cast("long")
    weighted = even.select("key", weight.alias("w"))
    if skewed:
        part = F.spark_partition_id()
        again = source.withColumn("part", part).filter(F.col("part").isin(skewed) & F.col("key").isNotNull())
        drawn = again.filter(F.rand(seed + 1) < rate).select("key", F.lit(round(1000 / rate)).cast("long").alias("w"))
        weighted = weighted.unionByName(drawn)
    return _cut(weighted.groupBy("key").agg(F.sum("w").alias("__w")), n)


def _partition_samples(source: DataFrame, most: int, seed: int) -> DataFrame:
    """(part, n, key): a uniform sample of each partition's non-null keys, and how many it has."""
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        random = np.random.default_rng([seed, part])
        n, draws, held = 0, np.zeros(0), None
        for batch in batches:
            keys = batch.column(0).drop_null()
            if not len(keys):
                continue
            n += len(keys)
            # the rows of the smallest draws so far are a uniform sample
            own = random.random(len(keys))
            below = np.flatnonzero(own < draws.max()) if len(draws) == most else np.arange(len(own))
            keys = keys.take(pa.array(below))
            held = keys if held is None else pa.concat_arrays([held, keys])
            draws = np.concatenate([draws, own[below]])
            if len(draws) > most:
                least = np.argpartition(draws, most)[:most]
                held, draws = held.take(pa.array(least)), draws[least]
        if held is not None:
            columns = [pa.array(np.full(len(held), part, np.int32)), pa.array(np.full(len(held), n, np.int64)), held]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "key"])

    return source.mapInArrow(run, f"part int, n long, key {kind}")


def _cut(weights: DataFrame, n: int) -> DataFrame:
    """(bound, key) from distinct keys and their whole weights ``__w``."""
    placed = running(
        weights.withColumn("__one", F.lit(1)),
        [],
        ["key"],
        {"__before": ("__w", "sum"), "__rank": ("__one", "sum")},
    )
    total_row = placed.agg(F.sum("__w")).first()[0]
    if total_row is None or n == 1:
        return weights.limit(0).select(F.lit(0).alias("bound"), "key")
    reached = F.expr(f"((__before + __w) * {n}L) div {total_row}L")
    # "reached" is how many of the n even steps the running weight has passed.
    # A key takes one bound only, so bounds trail behind "reached" after a heavy key:
    # taken(k) = min over i <= k of reached(i) + (k - i), and at most k.
    lead = placed.withColumn("__position", F.col("__rank") + 1).withColumn(
        "__gap", (reached - F.col("__position")).cast("long")
    )
    trailing = running(lead, [], ["key"], {"__least": ("__gap", "min")})
    before = F.least(F.coalesce("__least", F.lit(0)), F.lit(0))
    now = F.least(before, F.col("__gap"))
    taken_before = F.col("__position") - 1 + before
    taken = F.col("__position") + now
    return trailing.filter((taken > taken_before) & (taken < n)).select(
        taken.cast("int").alias("bound"), "key"
    )


def default_partitions(*inputs: DataFrame) -> int:
    """Partition count used when none is given.

    That of the input with the most partitions among those that are placed by hash already, so
    that it can stay as it is; else the configured one, else the largest input's.
    """
    require(bool(inputs), "at least one dataset is needed")
    placed = [layout[1] for layout in map(layout_of, inputs) if layout is not None]
    if placed:
        return max(placed)
    spark = inputs[0].sparkSession
    configured = spark.conf.get("spark.default.parallelism", None)
    if configured:
        return int(configured)
    return max(df.rdd.getNumPartitions() for df in inputs)


def partition_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def partition_subset(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows of chosen partitions with their partition id."""
    part = F.spark_partition_id()
    return df.select(part.alias("partition"), "*").filter(F.col("partition").isin(list(ids)))


def run_on_partitions(df: DataFrame, f: Any, ids: Sequence[int]) -> list[Any]:
    """Run a function on the rows of chosen partitions only; one result per partition."""
    results = df.sparkSession.sparkContext.runJob(
        df.rdd, lambda rows: [f(rows)], list(ids)
    )
    return list(results)
