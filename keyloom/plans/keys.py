"""Null-safe key handling. A null key is an ordinary key and equals another null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def prefixed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    """Rename ``names`` with a prefix, leaving the other columns alone."""
    return df.withColumnsRenamed({n: prefix + n for n in names})


def match(left: Sequence[str], right: Sequence[str], null_safe: bool = True) -> Column:
    """Equality of two key lists; null-safe unless told otherwise."""
    pairs = [(F.col(quoted(a)), F.col(quoted(b))) for a, b in zip(left, right, strict=True)]
    return all_of([a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
