"""Approximate aggregates: distinct-count sketches and estimates from part of the data."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import InheritableThread, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions.quantiles import confidence_factor, normal_quantile
from ..plans.checks import as_list, require
from ..plans.keys import cols, quoted

# Finest sketch that Spark offers, as the logarithm of its registers.
SKETCH_LG_K = 21


def precision_for(relative_sd: float) -> int:
    """Sketch precision for a relative standard deviation."""
    require(relative_sd > 0.000017, "relative_sd is too small")
    return max(4, math.ceil(2 * math.log2(1.054 / relative_sd)))


def approx_distinct_column(
    column: str, relative_sd: float = 0.05, p: int | None = None, sp: int = 0
) -> Column:
    """Distinct-count estimate as an aggregate.

    HyperLogLog++ down to 1 % deviation; finer precision, or an explicit ``p``, uses the
    mergeable sketch. What cannot be met raises: more than 2^21 registers, a sparse precision.
    """
    value = F.col(quoted(column))
    if p is None:
        p = precision_for(relative_sd)
        if relative_sd >= 0.01:
            # coarser wishes get a sketch that is small already and more exact
            return F.approx_count_distinct(value, min(relative_sd, 0.1))
    require(p >= 4, "p must be at least 4")
    require(sp <= 32, "sp must be at most 32")
    require(sp == 0 or p <= sp, "p must not exceed sp")
    require(p <= SKETCH_LG_K, f"no sketch here is finer than 2^{SKETCH_LG_K} registers")
    require(sp == 0, "a sparse precision cannot be chosen here")
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, p))


def count_approx_distinct(df: DataFrame, column: str, **precision: Any) -> DataFrame:
    return df.agg(approx_distinct_column(column, **precision).alias("distinct"))


def count_approx_distinct_by_key(
    df: DataFrame, keys: str | Sequence[str], column: str, **precision: Any
) -> DataFrame:
    return df.groupBy(*cols(as_list(keys))).agg(
        approx_distinct_column(column, **precision).alias("distinct")
    )


def distinct_sketches(df: DataFrame, keys: str | Sequence[str], column: str, lg_k: int = 12) -> DataFrame:
    """(keys…, sketch): a stored form of each key's distinct values, of at most 2^lg_k bytes.

    Sketches of parts of the data, made on any day, unite to that of the whole. Whole numbers,
    texts and bytes count as they are, other values by their text; -0.0 and 0.0 are one value.
    """
    require(4 <= lg_k <= SKETCH_LG_K, f"lg_k lies between 4 and {SKETCH_LG_K}")
    value, kind = F.col(quoted(column)), df.schema[column].dataType.simpleString()
    if kind in ("float", "double"):
        value = value + F.lit(0.0).cast(kind)
    if kind not in ("int", "bigint", "string", "binary"):
        value = value.cast("string")
    return df.groupBy(*cols(as_list(keys))).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def unite_sketches(sketches: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """(keys…, sketch): one sketch per key from many; fewer keys give coarser groups."""
    return sketches.groupBy(*cols(as_list(keys))).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_of(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    """The estimate of each sketch in place of it; its deviation is about 1.04 / 2^(lg_k / 2)."""
    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*cols(others), F.hll_sketch_estimate("sketch").alias(name))


# --- estimates from merged partials, as Column arithmetic ------------------------------


def _interval(
    merged: Column, total: Column, exact: Column, estimate: Column, half: Column, confidence: float
) -> Column:
    """struct<mean, confidence, low, high>: exact when all parts are merged, unknown when none."""
    done = merged >= total
    none = merged == 0
    infinite = F.lit(math.inf)

    def pick(all_parts: Column, no_parts: Column, some: Column) -> Column:
        return F.when(done, all_parts).when(none, no_parts).otherwise(some).cast("double")

    return F.struct(
        pick(exact, F.lit(0.0), estimate).alias("mean"),
        pick(F.lit(1.0), F.lit(0.0), F.lit(confidence)).alias("confidence"),
        pick(exact, -infinite, estimate - half).alias("low"),
        pick(exact, infinite, estimate + half).alias("high"),
    )


def _factor(count: Column, confidence: float) -> Column:
    """Confidence factor by number of values: t up to 100 values, normal above."""
    table = F.array(*[F.lit(confidence_factor(confidence, n)) for n in range(1, 101)])
    normal = F.lit(confidence_factor(confidence, 101))
    return F.when(count > 100, normal).when(
        count >= 1, F.element_at(table, F.greatest(count, F.lit(1)).cast("int"))
    )


def _count_parts(count: Column, merged: Column, total: Column) -> tuple[Column, Column]:
    p = merged.cast("double") / total
    return (count + 1 - p) / p, (count + 1) * (1 - p) / (p * p)


def count_estimate(count: Column, merged: Column, total: Column, confidence: float) -> Column:
    """Estimate of a count from ``merged`` of ``total`` parts."""
    mean, variance = _count_parts(count, merged, total)
    half = F.lit(normal_quantile(1 - (1 - confidence) / 2)) * F.sqrt(variance)
    return _interval(merged, total, count, mean, half, confidence)


def mean_estimate(
    count: Column, mean: Column, sample_variance: Column, merged: Column, total: Column,
    confidence: float,
) -> Column:
    half = _factor(count, confidence) * F.sqrt(sample_variance / count)
    return _interval(merged, total, mean, mean, half, confidence)


def sum_estimate(
    count: Column, mean: Column, sample_variance: Column, merged: Column, total: Column,
    confidence: float,
) -> Column:
    """Product of the estimated mean and the estimated count, with the product's variance."""
    n, n_variance = _count_parts(count, merged, total)
    m_variance = sample_variance / count
    variance = mean * mean * n_variance + n * n * m_variance + m_variance * n_variance
    half = _factor(count, confidence) * F.sqrt(variance)
    return _interval(merged, total, mean * count, mean * n, half, confidence)


def estimate_progress(
    df: DataFrame,
    part: Column,
    total_parts: int,
    column: str | None = None,
    by: str | Sequence[str] | None = None,
    what: str = "count",
    confidence: float = 0.95,
    after: Sequence[int] | None = None,
) -> DataFrame:
    """(merged, by…, estimate): the estimate once the first ``merged`` parts are in.

    ``part`` numbers the parts 0…total_parts-1; ``after`` lists the points of interest
    (default: after every part). All rows are aggregated once, per part and group, before
    any shuffle; then moments are added up part by part, so the work is linear in the parts. A
    group has no estimate before its first row is in.
    """
    require(what in ("count", "sum", "mean"), "what is 'count', 'sum' or 'mean'")
    require(0 < confidence < 1, "confidence lies in (0, 1)")
    require(what == "count" or column is not None, f"{what} needs a column")
    groups = as_list(by)
    x = F.lit(0.0) if column is None else F.col(quoted(column)).cast("double")
    count = F.count(F.lit(1) if column is None else x)
    partials = df.groupBy(*cols(groups), part.cast("long").alias("__part")).agg(
        count.alias("__n"), F.avg(x).alias("__mean"), (F.var_pop(x) * count).alias("__m2")
    )
    # Deviations from the group's first mean: no difference of large sums is ever taken.
    in_order = Window.partitionBy(*(cols(groups) or [F.lit(0)])).orderBy("__part")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = partials.filter("__n > 0").withColumns(
        {"__first": F.first("__mean").over(so_far), "__next": F.lead("__part").over(in_order)}
    ).withColumn("__d", F.col("__mean") - F.col("__first"))
    sums = {
        "__n": F.sum("__n").over(so_far),
        "__s1": F.sum(F.col("__n") * F.col("__d")).over(so_far),
        "__s2": F.sum(F.col("__m2") + F.col("__n") * F.col("__d") * F.col("__d")).over(so_far),
    }
    # what is merged with a part stays so until the group's next one: each point comes once
    first, last = F.col("__part") + 1, F.coalesce("__next", F.lit(total_parts).cast("long"))
    if after is None:
        points = F.when(first <= last, F.sequence(first, last))
    else:
        listed = F.array(*[F.lit(int(x)).cast("long") for x in after])
        points = F.filter(listed, lambda x: (x >= first) & (x <= last))
    merged = (
        off.withColumns(sums)
        .withColumn("merged", F.explode(points))
        .select(
            F.col("merged").cast("int").alias("merged"), *cols(groups), "__n",
            (F.col("__first") + F.col("__s1") / F.col("__n")).alias("__mean"),
            (F.col("__s2") - F.col("__s1") * F.col("__s1") / F.col("__n")).alias("__m2"),
        )
    )
    n, m, total, mean = F.col("__n"), F.col("merged"), F.lit(total_parts), F.col("__mean")
    variance = F.when(n > 1, F.col("__m2") / (n - 1)).otherwise(F.lit(math.nan))
    if what == "count":
        estimate = count_estimate(n, m, total, confidence)
    elif what == "mean":
        estimate = mean_estimate(n, mean, variance, m, total, confidence)
    else:
        estimate = sum_estimate(n, mean, variance, m, total, confidence)
    return merged.select("merged", *cols(groups), estimate.alias("estimate"))


# --- actions with a deadline -------------------------------------------------------------


@dataclass(frozen=True)
class Bounded:
    """An estimate with its confidence interval."""

    mean: float
    confidence: float
    low: float
    high: float


@dataclass
class _Moments:
    """Count, mean and squared deviations; merging is stable for large means."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def add(self, n: int, mean: float, m2: float) -> None:
        if n == 0:
            return
        both = self.n + n
        delta = mean - self.mean
        self.m2 += m2 + delta * delta * self.n * n / both
        self.mean += delta * n / both
        self.n = both

    @property
    def sample_variance(self) -> float:
        return self.m2 / (self.n - 1) if self.n > 1 else math.nan


class PartialResult:
    """First an estimate, later the exact value.

    ``initial`` waits for the estimate that was ready at the deadline, ``final`` for the
    value over all partitions. ``map`` transforms both.
    """

    def __init__(self) -> None:
        self._initial_ready = threading.Event()
        self._final_ready = threading.Event()
        self._initial: Any = None
        self._final: Any = None
        self._error: BaseException | None = None
        self._lock = threading.Lock()
        self._on_complete: list[Callable[[Any], None]] = []
        self._on_fail: list[Callable[[BaseException], None]] = []

    def _set_initial(self, value: Any) -> None:
        if not self._initial_ready.is_set():
            self._initial = value
            self._initial_ready.set()

    def _set_final(self, value: Any) -> None:
        self._set_initial(value)
        with self._lock:
            self._final = value
            self._final_ready.set()
            handlers = list(self._on_complete)
        for handler in handlers:
            handler(value)

    def _fail(self, error: BaseException) -> None:
        with self._lock:
            self._error = error
            self._initial_ready.set()
            self._final_ready.set()
            handlers = list(self._on_fail)
        for handler in handlers:
            handler(error)

    def _checked(self, value: Any) -> Any:
        if self._error is not None:
            raise self._error
        return value

    @property
    def is_final(self) -> bool:
        return self._final_ready.is_set() and self._error is None

    def initial(self, timeout: float | None = None) -> Any:
        self._initial_ready.wait(timeout)
        if self._initial_ready.is_set() and self._initial is None:
            self._checked(None)
        return self._initial

    def final(self, timeout: float | None = None) -> Any:
        if not self._final_ready.wait(timeout):
            raise TimeoutError("the exact value is not ready")
        return self._checked(self._final)

    def on_complete(self, handler: Callable[[Any], None]) -> PartialResult:
        with self._lock:
            done = self._final_ready.is_set()
            if not done:
                self._on_complete.append(handler)
        if done and self._error is None:
            handler(self._final)
        return self

    def on_fail(self, handler: Callable[[BaseException], None]) -> PartialResult:
        with self._lock:
            failed = self._error is not None
            if not failed:
                self._on_fail.append(handler)
        if failed:
            handler(self._error)
        return self

    def map(self, f: Callable[[Any], Any]) -> PartialResult:
        out = PartialResult()

        def relay() -> None:
            try:
                out._set_initial(f(self.initial()))
                out._set_final(f(self.final()))
            except BaseException as error:  # noqa: BLE001 - kept for the reader
                out._fail(error)

        threading.Thread(target=relay, daemon=True).start()
        return out


def _partition_moments(df: DataFrame, column: str | None) -> DataFrame:
    """One row (n, mean, m2) per partition, computed where the partition lies."""
    source = df.select(F.lit(0.0).alias("x") if column is None else F.col(quoted(column)).cast("double").alias("x"))
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Moments()
        for batch in batches:
            x = batch.column(0).drop_null()
            if len(x):
                total.add(len(x), pc.mean(x).as_py(), pc.variance(x).as_py() * len(x))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "n": total.n, "mean": total.mean, "m2": total.m2}], schema=schema
        )

    return source.mapInArrow(run, "part int, n long, mean double, m2 double")


def _bounded(what: str, moments: _Moments, merged: int, total: int, confidence: float) -> Bounded:
    n, mean = moments.n, moments.mean
    exact = {"count": float(n), "sum": mean * n, "mean": mean}[what]
    if merged >= total:
        return Bounded(exact, 1.0, exact, exact)
    if merged == 0:
        return Bounded(0.0, 0.0, -math.inf, math.inf)
    p = merged / total
    count_mean, count_var = (n + 1 - p) / p, (n + 1) * (1 - p) / (p * p)
    if what == "count":
        half = normal_quantile(1 - (1 - confidence) / 2) * math.sqrt(count_var)
        return Bounded(count_mean, confidence, count_mean - half, count_mean + half)
    mean_var = moments.sample_variance / n if n else math.nan
    factor = confidence_factor(confidence, n)
    if what == "mean":
        half = factor * math.sqrt(mean_var)
        return Bounded(mean, confidence, mean - half, mean + half)
    variance = mean * mean * count_var + count_mean**2 * mean_var + mean_var * count_var
    half = factor * math.sqrt(variance)
    centre = mean * count_mean
    return Bounded(centre, confidence, centre - half, centre + half)


def _with_deadline(
    df: DataFrame, column: str | None, what: str, timeout: float, confidence: float
) -> PartialResult:
    """Run growing batches of partitions; publish the estimate at the deadline."""

    def merge(state: _Moments, row: Any) -> None:
        state.add(row["n"], row["mean"], row["m2"])

    def tell(state: _Moments, merged: int, total: int) -> Bounded:
        return _bounded(what, state, merged, total, confidence)

    return _growing(df, _partition_moments(df, column), _Moments(), merge, tell, timeout, confidence)


def _growing(
    df: DataFrame, partials: DataFrame, state: Any, merge: Callable, tell: Callable, timeout: float, confidence: float
) -> PartialResult:
    require(timeout >= 0, "timeout must not be negative")
    require(0 < confidence < 1, "confidence lies in (0, 1)")
    result = PartialResult()
    deadline = time.monotonic() + timeout
    moments_rdd = partials.rdd
    total = moments_rdd.getNumPartitions()
    sc = df.sparkSession.sparkContext
    merged = 0
    lock = threading.Lock()

    def snapshot() -> Any:
        with lock:
            return tell(state, merged, total)

    def work() -> None:
        nonlocal merged
        try:
            size = max(1, sc.defaultParallelism)
            while merged < total:
                batch = list(range(merged, min(total, merged + size)))
                rows = sc.runJob(moments_rdd, list, batch)
                with lock:
                    for row in rows:
                        merge(state, row)
                    merged += len(batch)
                size *= 2
            result._set_final(snapshot())
        except BaseException as error:  # noqa: BLE001 - handed to the caller
            result._fail(error)

    def alarm() -> None:
        result._final_ready.wait(max(0.0, deadline - time.monotonic()))
        if not result._final_ready.is_set():
            result._set_initial(snapshot())

    InheritableThread(target=work, daemon=True).start()
    threading.Thread(target=alarm, daemon=True).start()
    return result


def count_approx(df: DataFrame, timeout: float, confidence: float = 0.95) -> PartialResult:
    return _with_deadline(df, None, "count", timeout, confidence)


def sum_approx(df: DataFrame, column: str, timeout: float, confidence: float = 0.95) -> PartialResult:
    return _with_deadline(df, column, "sum", timeout, confidence)


def mean_approx(df: DataFrame, column: str, timeout: float, confidence: float = 0.95) -> PartialResult:
    return _with_deadline(df, column, "mean", timeout, confidence)


# --- grouped estimates ---------------------------------------------------------------------


def _grouped_moments(df: DataFrame, keys: list[str], column: str | None) -> DataFrame:
    """(keys, n, mean, m2) per partition and key, computed where the partition lies."""
    x = F.lit(0.0) if column is None else F.col(quoted(column)).cast("double")
    source = df.select(*cols(keys), x.alias("__x"))
    schema = T.StructType(
        [*source.schema.fields[:-1], *T.StructType.fromDDL("__n long, __mean double, __m2 double").fields]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grouped = batch.groupby(keys, dropna=False, sort=False)["__x"]
            out = grouped.agg(__n="count", __mean="mean", __m2=lambda v: v.var(ddof=0) * v.count()).reset_index()
            yield out[out["__n"] > 0]

    return source.mapInPandas(run, schema)


def _grouped_with_deadline(
    df: DataFrame, keys: str | Sequence[str], column: str | None, what: str, timeout: float, confidence: float
) -> PartialResult:
    """As ``_with_deadline``, with a dict from key to estimate.

    The dict is the result by contract and lives on the driver: for keys that fit there.
    """
    names = as_list(keys)

    def key_of(row: Any) -> Any:
        values = tuple(row[: len(names)])
        return values if len(names) > 1 else values[0]

    def merge(state: dict, row: Any) -> None:
        state.setdefault(key_of(row), _Moments()).add(row["__n"], row["__mean"], row["__m2"])

    def tell(state: dict, merged: int, total: int) -> dict:
        return {k: _bounded(what, m, merged, total, confidence) for k, m in state.items()}

    return _growing(df, _grouped_moments(df, names, column), {}, merge, tell, timeout, confidence)


def count_by_key_approx(
    df: DataFrame, keys: str | Sequence[str], timeout: float, confidence: float = 0.95
) -> PartialResult:
    """{key: estimate of its rows}; keys not met before the deadline are missing from ``initial``."""
    return _grouped_with_deadline(df, keys, None, "count", timeout, confidence)


def count_by_value_approx(df: DataFrame, timeout: float, confidence: float = 0.95) -> PartialResult:
    """``count_by_key_approx`` with the whole row as the key."""
    return count_by_key_approx(df, df.columns, timeout, confidence)


def grouped_sum_approx(
    df: DataFrame, keys: str | Sequence[str], column: str, timeout: float, confidence: float = 0.95
) -> PartialResult:
    return _grouped_with_deadline(df, keys, column, "sum", timeout, confidence)


def grouped_mean_approx(
    df: DataFrame, keys: str | Sequence[str], column: str, timeout: float, confidence: float = 0.95
) -> PartialResult:
    return _grouped_with_deadline(df, keys, column, "mean", timeout, confidence)


def grouped_progress(
    df: DataFrame, keys: str | Sequence[str], part: Column, total_parts: int, what: str = "count",
    column: str | None = None, confidence: float = 0.95,
) -> DataFrame:
    """``estimate_progress`` by key: estimates as a table, for any number of keys."""
    return estimate_progress(df, part, total_parts, column, keys, what, confidence)
