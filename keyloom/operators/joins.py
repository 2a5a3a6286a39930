"""Joins and cogroups by key. Null keys match null keys unless ``null_safe=False``.

Skew: AQE splits the hot partitions of an inner join, and of the row-preserving side of an
outer join. For the side it cannot split, keys above ``rows_per_task`` rows are counted
first and salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import as_list, key_and_values, require
from ..plans.keys import any_of, cols, match, prefixed
from ..plans.prefix import FILE, ROW
from ..plans.skew import (
    ROWS_PER_TASK,
    broadcast_if_small,
    group_in_chunks,
    hot_groups,
    numbered,
    with_parts,
)

_HOWS = ("inner", "left", "right", "full")


def join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    null_safe: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join: the keys, then the values of both sides; all pairs of matching rows."""
    require(how in _HOWS, f"how is one of {_HOWS}")
    names, left_values = key_and_values(left, keys)
    _, right_values = key_and_values(right, keys)
    clash = set(left_values) & set(right_values)
    require(not clash, f"both sides have value columns {sorted(clash)}")
    hot_left = hot_groups(left, names, rows_per_task) if how in ("right", "full") else None
    hot_right = hot_groups(right, names, rows_per_task) if how in ("left", "full") else None
    salted = hot_left is not None or hot_right is not None
    if salted:
        left = _salted(left, names, hot_left, hot_right, "left", null_safe)
        right = _salted(right, names, hot_left, hot_right, "right", null_safe)
    else:
        left, right = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))
    right_names = ["__r_" + n for n in names]
    right = prefixed(right, names, "__r_")
    condition = match(names, right_names, null_safe)
    if salted:
        condition &= match(["__l_ls", "__l_rs"], ["__r_ls", "__r_rs"], null_safe=False)
    joined = left.join(right, condition, how)
    if salted:
        # A key split on one side exists on that side, so a row of the other side that found
        # no partner in one of the parts is a copy that has its partners in other parts.
        lost_left = F.col("__l").isNull() & (F.col("__r_lp") > 1)
        lost_right = F.col("__r").isNull() & (F.col("__l_rp") > 1)
        joined = joined.filter(~F.coalesce(lost_left, F.lit(False)))
        joined = joined.filter(~F.coalesce(lost_right, F.lit(False)))
    if how == "right":
        key_columns = [F.col("__r_" + n).alias(n) for n in names]
    elif how == "full":
        key_columns = [F.coalesce(F.col(n), F.col("__r_" + n)).alias(n) for n in names]
    else:
        key_columns = cols(names)
    return joined.select(*key_columns, *cols(left_values), *cols(right_values))


def _salted(
    df: DataFrame,
    names: Sequence[str],
    hot_left: DataFrame | None,
    hot_right: DataFrame | None,
    own: str,
    null_safe: bool,
) -> DataFrame:
    """Split this side's hot keys by position; repeat rows for the other side's parts.

    Adds marker ``__l``/``__r`` and, prefixed by it, the parts (lp, rp) and salts (ls, rs).
    """
    p = "__l" if own == "left" else "__r"
    mine, theirs, own_hot = ("l", "r", hot_left) if own == "left" else ("r", "l", hot_right)
    table, place = (df, F.lit(0)) if own_hot is None else numbered(df)
    marked = table.withColumns({p: F.lit(1), "__place": place})
    marked = with_parts(marked, names, hot_left, f"{p}_lp")
    marked = with_parts(marked, names, hot_right, f"{p}_rp")
    if not null_safe:  # a row with a null key has no partners to be repeated for
        has_null = any_of([c.isNull() for c in cols(names)])
        other = F.col(f"{p}_{theirs}p")
        marked = marked.withColumn(f"{p}_{theirs}p", F.when(has_null, 1).otherwise(other))
    return (
        marked.withColumn(f"{p}_{mine}s", F.pmod("__place", F.col(f"{p}_{mine}p")).cast("int"))
        .withColumn(f"{p}_{theirs}s", F.explode(F.sequence(F.lit(0), F.col(f"{p}_{theirs}p") - 1)))
        .drop("__place", FILE, ROW)
    )


def left_outer_join(left, right, keys, **options) -> DataFrame:
    return join(left, right, keys, "left", **options)


def right_outer_join(left, right, keys, **options) -> DataFrame:
    return join(left, right, keys, "right", **options)


def full_outer_join(left, right, keys, **options) -> DataFrame:
    return join(left, right, keys, "full", **options)


def cartesian(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows: the operator itself is the product, so its size is n1*n2.

    A right side of counted, small size is broadcast; otherwise Spark pairs partitions.
    """
    clash = set(left.columns) & set(right.columns)
    require(not clash, f"both sides have {sorted(clash)}")
    return left.crossJoin(broadcast_if_small(right))


def _tagged(
    datasets: Sequence[DataFrame], keys: str | Sequence[str], names: Sequence[str] | None
) -> tuple[DataFrame, list[str], list[Column]]:
    """All rows in one table, each with its value under the name of its dataset; the lists to make."""
    require(2 <= len(datasets) <= 4, "two to four datasets can be cogrouped")
    sides = as_list(names) or [f"side{i}" for i in range(len(datasets))]
    require(len(sides) == len(datasets), "one name per dataset is needed")
    key_names = as_list(keys)
    tagged = None
    for i, df in enumerate(datasets):
        _, values = key_and_values(df, key_names)
        value = F.struct(*cols(values)) if values else F.struct(F.lit(True).alias("present"))
        packed = df.select(
            *cols(key_names),
            *[
                value.alias(s)
                if j == i
                else F.lit(None).cast(_value_type(datasets[j], key_names)).alias(s)
                for j, s in enumerate(sides)
            ],
        )
        tagged = packed if tagged is None else tagged.unionByName(packed)
    # a struct keeps null values; collect_list skips only the rows of the other sides
    return tagged, key_names, [F.collect_list(s).alias(s) for s in sides]


def cogroup(
    datasets: Sequence[DataFrame], keys: str | Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Per key, one list of value structs for each of two to four datasets.

    Keys of any dataset appear, each in one row; a dataset without the key gives an empty
    list. One shuffle for all sides. ``cogroup_chunks`` is for keys too large for a row.
    """
    tagged, key_names, lists = _tagged(datasets, keys, names)
    return tagged.groupBy(*cols(key_names)).agg(*lists)


def cogroup_chunks(
    datasets: Sequence[DataFrame],
    keys: str | Sequence[str],
    names: Sequence[str] | None = None,
    rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """``cogroup`` with every key in numbered chunks (column ``chunk``) of about ``rows_per_chunk`` rows.

    Every value of every dataset is in exactly one chunk of its key, so lists that stand side
    by side in a chunk are parts, not all, of what the datasets have.
    """
    tagged, key_names, lists = _tagged(datasets, keys, names)
    return group_in_chunks(tagged, key_names, lists, rows_per_chunk)


def _value_type(df: DataFrame, keys: Sequence[str]):
    _, values = key_and_values(df, keys)
    value = F.struct(*cols(values)) if values else F.struct(F.lit(True).alias("present"))
    return df.select(value.alias("v")).schema["v"].dataType


def group_with(datasets: Sequence[DataFrame], keys: str | Sequence[str], **options) -> DataFrame:
    """Another name of ``cogroup``."""
    return cogroup(datasets, keys, **options)


def subtract_by_key(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Left rows whose key is absent on the right; duplicates on the left are kept.

    The right side is reduced to distinct keys before the shuffle; AQE splits hot left keys.
    """
    names, _ = key_and_values(left, keys)
    absent = prefixed(right.select(*cols(names)).distinct(), names, "__r_")
    return left.join(absent, match(names, ["__r_" + n for n in names]), "left_anti")


def broadcast_join(
    large: DataFrame, small: DataFrame, keys: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Map-side join: no shuffle of the large side when the small side is counted small.

    A small side beyond the bound falls back to a shuffled join with the same result.
    """
    require(how in ("inner", "left"), "a map-side join is 'inner' or 'left'")
    names, large_values = key_and_values(large, keys)
    _, small_values = key_and_values(small, keys)
    right = prefixed(small, names, "__r_")
    joined = large.join(
        broadcast_if_small(right), match(names, ["__r_" + n for n in names]), how
    )
    return joined.select(*cols(names), *cols(large_values), *cols(small_values))


__all__ = [
    "broadcast_join",
    "cartesian",
    "cogroup",
    "cogroup_chunks",
    "full_outer_join",
    "group_with",
    "join",
    "left_outer_join",
    "right_outer_join",
    "subtract_by_key",
]
