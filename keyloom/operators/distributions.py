"""Histograms and exact quantiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import EmptyInputError, as_list, require
from ..plans.keys import cols, match, prefixed, quoted
from ..plans.prefix import FILE, file_spans, running_in, sorted_table
from ..plans.shared import materialise
from .aggregates import stats

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
ROWS_PER_TASK = 100_000


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, low, high, count): even buckets between min and max, the last one closed.

    All equal values give one bucket. No rows, NaN or infinite extremes raise.
    """
    require(buckets >= 1, "at least one bucket is needed")
    x = F.col(quoted(column)).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        raise EmptyInputError("empty collection")
    require(math.isfinite(low) and math.isfinite(high), "the extremes must be finite numbers")
    if low == high:
        buckets = 1
    edges = [low + (high - low) * i / buckets for i in range(buckets)] + [high]
    return histogram_edges(df, column, edges, even=True)


def histogram_edges(
    df: DataFrame, column: str, edges: Sequence[float], even: bool = False
) -> DataFrame:
    """Counts per bucket [a, b), the last one closed; values outside are dropped.

    NaN counts only when the last edge is NaN (it sorts above every number). ``even`` finds
    the bucket by arithmetic instead of by comparing edges.
    """
    require(len(edges) >= 2, "at least two edges are needed")
    ordered = [(math.isnan(e), e) for e in edges]
    rising = all(a < b for a, b in zip(ordered[:-1], ordered[1:], strict=True))
    require(rising or (even and len(edges) == 2), "edges must be sorted and distinct")
    n = len(edges) - 1
    x = F.col(quoted(column)).cast("double")
    inside = (x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1])))
    if even and edges[0] < edges[-1]:
        width = (edges[-1] - edges[0]) / n
        bucket = F.least(F.floor((x - F.lit(edges[0])) / F.lit(width)), F.lit(n - 1))
    else:
        bucket = _search(x, [float(e) for e in edges], 0, n - 1)
    counts = (
        df.filter(inside).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.createDataFrame(
        [(i, float(edges[i]), float(edges[i + 1])) for i in range(n)],
        "bucket int, low double, high double",
    )
    return frame.join(counts, "bucket", "left").select(
        "bucket", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("count")
    )


def _search(x: Column, edges: Sequence[float], first: int, last: int) -> Column:
    """Bucket of a value inside the edges, as a balanced tree of comparisons."""
    if first == last:
        return F.lit(first)
    middle = (first + last + 1) // 2
    return F.when(x < F.lit(edges[middle]), _search(x, edges, first, middle - 1)).otherwise(
        _search(x, edges, middle, last)
    )


def closest_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float] = QUARTILES,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """(by…, probability, value): the element at index min(floor(p*n), n-1) of the sorted data.

    Exact, no interpolation; nulls are skipped. Equal values are counted before the shuffle
    and positions come from running totals over range partitions, so neither a huge group
    nor a huge run of one value has to fit in a task.
    """
    require(all(0.0 <= p <= 1.0 for p in probabilities), "probabilities lie in [0, 1]")
    groups = as_list(by)
    value = F.col(quoted(column))
    counts = (
        df.filter(value.isNotNull())
        .groupBy(*cols(groups), value.alias("__value"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])

    def hits(total: Column, start: Column, size: Column) -> Column:
        """The probabilities whose index lies in the span that begins at ``start``."""

        def inside(p: Column) -> Column:
            index = F.least(F.floor(p * total), total - 1)
            return (index >= start) & (index < start + size)

        return F.filter(wanted, inside)

    measures = {"__c": ("__n", "sum")}
    table = sorted_table(counts, [*cols(groups), F.col("__value")])
    spans = materialise(file_spans(table, groups, measures), "spans")
    start = F.coalesce(F.col("__c__before"), F.lit(0))
    in_span = hits(F.col("__c__total"), start, F.col("__c"))
    # at most one number per written file; files without a wanted position are not read again
    files = [r[0] for r in spans.filter(F.size(in_span) > 0).select(FILE).distinct().toLocalIterator()]
    placed = running_in(table.filter(F.col(FILE).isin(files)), spans, groups, measures)
    return placed.select(
        *cols(groups),
        F.explode(hits(F.col("__c__total"), F.col("__c"), F.col("__n"))).alias("probability"),
        F.col("__value").alias("value"),
    )


def closest_quantiles_of_columns(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float] = QUARTILES,
    by: str | Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(by…, metric, probability, value): ``closest_quantiles`` of many columns, exact for every group.

    A group of up to ``rows_per_task`` rows is gathered once and its columns are sorted there, so rows are not
    multiplied by the columns before the shuffle. Larger groups go through ``closest_quantiles``. A column
    without values in a group is left out.
    """
    require(all(0.0 <= p <= 1.0 for p in probabilities), "probabilities lie in [0, 1]")
    groups = as_list(by)
    names = {f"__m{i}": name for i, name in enumerate(columns)}
    values = [c.cast("double") for c in columns.values()]
    # 0.0 and -0.0 are one value
    wide = df.select(
        *cols(groups), *[F.when(v == 0, F.lit(0.0)).otherwise(v).alias(m) for m, v in zip(names, values, strict=True)]
    )
    counted = wide.groupBy(*cols(groups)).agg(F.count(F.lit(1)).alias("__n"))
    large = materialise(counted.filter(F.col("__n") > rows_per_task).select(*cols(groups), F.lit(1).alias("__large")), "large")
    found = []
    small = wide
    if not large.isEmpty():
        marked = prefixed(large, groups, "__l_")
        on = match(groups, ["__l_" + g for g in groups]) if groups else F.lit(True)
        small = wide.join(marked, on, "left_anti")
        long = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(m).alias("value")) for m, name in names.items()])
        rest = wide.join(marked, on, "left_semi").select(*cols(groups), F.inline(long))
        found.append(closest_quantiles(rest, "value", probabilities, [*groups, "metric"]))

    def sorted_values(m: str) -> Column:
        return F.array_sort(F.filter(F.transform("__rows", lambda r: r[m]), lambda v: v.isNotNull()))

    metrics = [F.struct(F.lit(name).alias("metric"), sorted_values(m).alias("__values")) for m, name in names.items()]
    wanted = F.array(*[F.lit(float(p)) for p in probabilities]).cast("array<double>")
    n = F.size("__values")
    index = F.least(F.floor(F.col("probability") * n), n - 1).cast("int")
    in_place = (
        small.groupBy(*cols(groups))
        .agg(F.collect_list(F.struct(*names)).alias("__rows"))
        .select(*cols(groups), F.inline(F.array(*metrics)))
        .filter(n > 0)
        .select("*", F.explode(wanted).alias("probability"))
        .select(*cols(groups), "metric", "probability", F.get("__values", index).alias("value"))
    )
    return in_place.unionByName(found[0]) if found else in_place


def sketched_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float] = QUARTILES,
    by: str | Sequence[str] | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """(by…, metric, probability, value): quantiles of many columns of many groups, approximately.

    The rank of a value is off by at most one place and 1 / ``accuracy`` of the group's values.
    Every group has one bounded state for each column, combined before the shuffle: rows are read once and never
    multiplied by the columns. A column without values in a group is left out.
    """
    require(all(0.0 <= p <= 1.0 for p in probabilities), "probabilities lie in [0, 1]")
    require(accuracy >= 1, "accuracy must be positive")
    groups = as_list(by)
    names = {f"__m{i}": name for i, name in enumerate(columns)}
    points = [F.lit(float(p)) for p in probabilities]
    wide = (
        df.select(*cols(groups), *[c.cast("double").alias(m) for m, c in zip(names, columns.values(), strict=True)])
        .groupBy(*cols(groups))
        .agg(*[F.percentile_approx(m, F.array(*points), F.lit(accuracy)).alias(m) for m in names])
    )
    found = [
        F.struct(F.lit(name).alias("metric"), p.alias("probability"), F.get(m, F.lit(i)).alias("value"))
        for m, name in names.items()
        for i, p in enumerate(points)
    ]
    return wide.select(*cols(groups), F.inline(F.array(*found))).filter(F.col("value").isNotNull())


def quantile_sketches(df: DataFrame, column: str, by: str | Sequence[str] | None = None, k: int = 200) -> DataFrame:
    """(by…, sketch): a stored KLL sketch of a column, that sketches of other parts unite with."""
    return df.groupBy(*cols(as_list(by))).agg(
        F.kll_sketch_agg_double(F.col(quoted(column)).cast("double"), F.lit(k)).alias("sketch")
    )


def unite_quantile_sketches(sketches: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    return sketches.groupBy(*cols(as_list(by))).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(sketches: DataFrame, probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """(by…, probability, value) from stored sketches; the rank error is about 1.65 % with k = 200."""
    others = cols([c for c in sketches.columns if c != "sketch"])
    points = [
        F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
        for p in probabilities
    ]
    return sketches.select(*others, F.inline(F.array(*points)))


def distribution_summary(
    df: DataFrame, column: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Statistics and the five quartile points of a column, one row per group."""
    groups = as_list(by)
    names = ["q0", "q25", "q50", "q75", "q100"]
    points = closest_quantiles(df, column, QUARTILES, groups)
    wide = points.groupBy(*cols(groups)).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n)
            for p, n in zip(QUARTILES, names, strict=True)
        ]
    )
    numbers = stats(df, column, groups)
    if not groups:
        one = F.lit(0).alias("__all")
        return numbers.select("*", one).join(F.broadcast(wide.select("*", one)), "__all").drop("__all")
    return numbers.join(
        prefixed(wide, groups, "__q_"), match(groups, ["__q_" + g for g in groups])
    ).select(*cols(numbers.columns), *names)


__all__ = [
    "QUARTILES",
    "closest_quantiles",
    "closest_quantiles_of_columns",
    "distribution_summary",
    "histogram",
    "histogram_edges",
    "quantile_sketches",
    "quantiles_of",
    "sketched_quantiles",
    "unite_quantile_sketches",
]
