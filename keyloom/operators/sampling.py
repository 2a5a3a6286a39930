"""Sampling. Draws are repeatable for a seed and the same partitions.

Operators that promise exact sizes write their random draws once, so that every later pass
and every retried task sees the same draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checks import require, require_columns
from ..plans.keys import cols, match, quoted
from ..plans.prefix import with_position
from ..plans.shared import materialise
from ..plans.skew import broadcast_if_small

DRAW = "__draw"
COPIES_PER_BATCH = 10_000
SURE = 4.5  # standard deviations of safety in sample sizes


def sample(df: DataFrame, fraction: float, seed: int, with_replacement: bool = False) -> DataFrame:
    """Bernoulli sample, or Poisson copies when drawing with replacement."""
    _check_fraction(fraction, with_replacement)
    return df.sample(with_replacement, float(fraction), seed)


def _check_fraction(fraction: float, with_replacement: bool) -> None:
    require(fraction >= 0, "a fraction must not be negative")
    require(with_replacement or fraction <= 1, "a fraction above 1 needs replacement")


def with_draw(df: DataFrame, seed: int) -> DataFrame:
    """Add one uniform draw per row, written once."""
    return materialise(df.withColumn(DRAW, F.rand(seed)), "draws")


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Disjoint parts that together are the whole dataset, with shares in proportion."""
    require(bool(weights) and all(w >= 0 for w in weights), "weights must not be negative")
    total = sum(weights)
    require(total > 0, "the weights add up to zero")
    drawn = with_draw(df, seed)
    edges = [0.0]
    for w in weights:
        edges.append(edges[-1] + w / total)
    edges[-1] = 1.0
    return [_cell(drawn, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _cell(drawn: DataFrame, low: float, high: float) -> DataFrame:
    return drawn.filter((F.col(DRAW) >= low) & (F.col(DRAW) < high)).drop(DRAW)


def cell_sample(
    df: DataFrame, low: float, high: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """(rows whose draw is in [low, high), all other rows)."""
    require(0 <= low <= high <= 1, "a cell lies in [0, 1]")
    drawn = with_draw(df, seed)
    inside = (F.col(DRAW) >= low) & (F.col(DRAW) < high)
    return drawn.filter(inside).drop(DRAW), drawn.filter(~inside).drop(DRAW)


def oversampling_fraction(n: int, total: int, with_replacement: bool) -> float:
    """Rate that yields at least ``n`` of ``total`` rows except once in 10,000 tries.

    The expected size m is the one that lies SURE standard deviations of a Poisson count
    above n. A Bernoulli sample varies less, so the same rate is enough for it.
    """
    half = SURE / 2
    expected = (half + math.sqrt(n + half * half)) ** 2
    rate = expected / total
    return rate if with_replacement else min(1.0, rate)


def take_sample(df: DataFrame, n: int, seed: int, with_replacement: bool = False) -> DataFrame:
    """A random sample of exactly ``n`` rows (all rows when there are fewer, without replacement).

    Only a slightly larger sample is written and cut, not the dataset.
    """
    require(n >= 0, "n must not be negative")
    total = df.count() if n else 0
    if n == 0 or total == 0:
        return df.limit(0)
    if not with_replacement and n >= total:
        return df
    fraction = oversampling_fraction(n, total, with_replacement)
    attempt = 0
    while True:
        rows = df.sample(with_replacement, fraction, seed + attempt)
        drawn = with_draw(rows, seed + 7919 * (attempt + 1))
        if drawn.count() >= n:
            placed, _ = with_position(drawn, [F.col(DRAW)], "__rank")
            return placed.filter(F.col("__rank") < n).drop("__rank", DRAW)
        attempt += 1


Rates = Mapping[Any, float] | DataFrame


def _rated(df: DataFrame, key: str, rates: Rates, with_replacement: bool) -> DataFrame:
    """Add ``__rate``, the rate of the row's key; a key without a rate raises when it is met."""
    kind = df.schema[key].dataType
    if isinstance(rates, DataFrame):
        of_key, rate = rates.columns
        table = rates.select(F.col(quoted(of_key)).cast(kind).alias("__rate_key"), F.col(quoted(rate)).cast("double").alias("__given"))
    else:
        require(bool(rates), "no rates given")
        for rate in rates.values():
            _check_fraction(rate, with_replacement)
        schema = T.StructType([T.StructField("__rate_key", kind), T.StructField("__given", T.DoubleType())])
        table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in rates.items()], schema)
    joined = df.join(broadcast_if_small(table), F.col(quoted(key)).eqNullSafe(F.col("__rate_key")), "left")
    given = F.col("__given")
    right = (given >= 0) if with_replacement else given.between(0.0, 1.0)
    name = F.coalesce(F.col(quoted(key)).cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit("no rate for key "), name)).cast("double")
    return joined.withColumn("__rate", F.when(right, given).otherwise(wrong)).drop("__rate_key", "__given")


def sample_by_key(
    df: DataFrame, key: str, fractions: Rates, seed: int, with_replacement: bool = False
) -> DataFrame:
    """Sample each key at its own rate in one pass. A key without a rate is an error.

    Rates are a mapping, or a table of keys and rates where there are many.
    """
    require_columns(df, [key])
    if not with_replacement:
        drawn = df.withColumn("__chance", F.rand(seed))  # drawn where the rows lie, before any join
        kept = _rated(drawn, key, fractions, False).filter(F.col("__chance") < F.col("__rate"))
        return kept.select(*cols(df.columns))
    return _poisson_copies(_rated(df, key, fractions, True), seed).drop("__rate")


def _poisson_copies(rated: DataFrame, seed: int) -> DataFrame:
    """Repeat each row a Poisson number of times with mean ``__rate``; rows stay in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            rates = batch.column("__rate").to_numpy(zero_copy_only=False)
            copies = np.repeat(np.arange(len(rates)), generator.poisson(rates))
            for start in range(0, len(copies), COPIES_PER_BATCH):
                yield batch.take(pa.array(copies[start : start + COPIES_PER_BATCH]))

    return rated.mapInArrow(run, rated.schema)


def sample_by_key_exact(
    df: DataFrame, key: str, fractions: Rates, seed: int, with_replacement: bool = False
) -> DataFrame:
    """Exactly ``ceil(count * rate)`` rows of every key.

    A histogram of the draws finds, per key, the cell in which the threshold falls. Rows in
    lower cells are accepted at once; only that one cell is ranked, so a hot key never goes
    through one window.
    """
    require_columns(df, [key])
    counts = df.groupBy(*cols([key])).agg(F.count(F.lit(1)).alias("__n"))
    needed = (
        _rated(counts, key, fractions, with_replacement)
        .withColumn("__need", F.ceil(F.col("__n") * F.col("__rate")))
        .withColumn("__cells", F.ceil(F.sqrt("__n")))
        .select(F.col(quoted(key)).alias("__key"), "__need", "__n", "__cells")
    )
    needed = materialise(needed, "needed")
    boost = 1.0
    while True:
        if with_replacement:
            margin = boost * (F.col("__need") + 6 * F.sqrt("__need") + 12) / F.col("__n")
            rated = (
                df.join(broadcast_if_small(needed), F.col(quoted(key)).eqNullSafe(F.col("__key")))
                .withColumn("__rate", F.when(F.col("__need") > 0, margin).otherwise(0.0))
                .drop("__key", "__need", "__n", "__cells")
            )
            drawn = with_draw(_poisson_copies(rated, seed + int(boost)).drop("__rate"), seed)
            have = drawn.groupBy(*cols([key])).agg(F.count(F.lit(1)).alias("__have"))
            short = needed.join(have, F.col("__key").eqNullSafe(F.col(quoted(key))), "left").filter(
                F.coalesce("__have", F.lit(0)) < F.col("__need")
            )
            if not short.isEmpty():
                boost *= 2
                continue
        else:
            drawn = with_draw(df, seed)
        return _smallest_draws(drawn, key, needed).select(*cols(df.columns))


def _smallest_draws(drawn: DataFrame, key: str, needed: DataFrame) -> DataFrame:
    """The ``__need`` rows with the smallest draws of every key."""
    same_key = F.col(quoted(key)).eqNullSafe(F.col("__key"))
    cell = F.floor(F.col(DRAW) * F.col("__cells"))
    small = broadcast_if_small(needed)
    celled = drawn.join(small, same_key).withColumn("__cell", cell)
    upto = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        celled.groupBy("__key", "__need", "__cell")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__before", F.coalesce(F.sum("__c").over(upto), F.lit(0)))
        .filter((F.col("__before") < F.col("__need")) & (F.col("__before") + F.col("__c") >= F.col("__need")))
        .select(
            F.col("__key").alias("__cut_key"),
            F.col("__cell").alias("__cut_cell"),
            (F.col("__need") - F.col("__before")).alias("__rest"),
        )
    )
    placed = celled.join(
        broadcast_if_small(materialise(cut, "cuts")), match(["__key"], ["__cut_key"])
    )
    sure = placed.filter(F.col("__cell") < F.col("__cut_cell"))
    edge = placed.filter(F.col("__cell") == F.col("__cut_cell"))
    by_draw = Window.partitionBy("__key").orderBy(DRAW, F.monotonically_increasing_id())
    ranked = edge.withColumn("__rank", F.row_number().over(by_draw))
    chosen = ranked.filter(F.col("__rank") <= F.col("__rest")).drop("__rank")
    return sure.unionByName(chosen)


def reservoir_per_partition(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Up to ``k`` random rows of each partition with the partition's id and exact size.

    One pass; a task holds at most ``k`` rows and one batch.
    """
    require(k >= 1, "k must be positive")
    schema = T.StructType(
        [
            T.StructField("partition", T.IntegerType()),
            T.StructField("partition_rows", T.LongType()),
            *df.schema,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        generator = np.random.default_rng([seed, part])
        kept, draws, seen = None, np.empty(0), 0
        for batch in batches:
            seen += batch.num_rows
            here = pa.Table.from_batches([batch])
            both = here if kept is None else pa.concat_tables([kept, here])
            draws = np.concatenate([draws, generator.random(batch.num_rows)])
            best = np.argsort(draws, kind="stable")[:k]
            kept, draws = both.take(pa.array(best)), draws[best]
        if kept is not None and seen:
            n = kept.num_rows
            ids = pa.array([part] * n, pa.int32()), pa.array([seen] * n, pa.int64())
            columns = [*ids, *[c.combine_chunks() for c in kept.columns]]
            names = ["partition", "partition_rows", *kept.column_names]
            yield from pa.Table.from_arrays(columns, names=names).to_batches()

    return df.mapInArrow(run, schema)
