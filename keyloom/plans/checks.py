"""Argument checks. Every check raises ``ValueError`` before any job starts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


class EmptyInputError(ValueError):
    """Raised by actions that have no answer for an empty dataset."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def as_list(names: str | Sequence[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    require(not missing, f"unknown columns {missing}; have {df.columns}")


def key_and_values(
    df: DataFrame, keys: str | Sequence[str], values: str | Sequence[str] | None = None
) -> tuple[list[str], list[str]]:
    """Split the columns into key columns and value columns (default: all others)."""
    key_names = as_list(keys)
    require(bool(key_names), "at least one key column is needed")
    value_names = as_list(values) or [c for c in df.columns if c not in key_names]
    require_columns(df, key_names + value_names)
    return key_names, value_names
