"""What a Python worker keeps between tasks.

Functions reach the executors by value, so their module globals are new in every task. Worker
processes are reused; a table kept here spares the next task in the process the same work. It
is only a cache: a new worker fills its own, and a worker keeps the tables of one operator, the
last that it has worked for.
"""

from __future__ import annotations

import sys
import types

import pyarrow as pa


def kept(name: str | None) -> dict:
    """The table of that name; all others are dropped. None only drops."""
    place = sys.modules.setdefault("_keyloom_kept", types.ModuleType("_keyloom_kept")).__dict__
    tables = place.setdefault("tables", {})
    if name not in tables:
        tables.clear()
        pa.default_memory_pool().release_unused()
    return tables.setdefault(name, {})


def vocabulary_path(path: str | None, default: str) -> str:
    """``path``, or the default vocabulary file where this process finds it."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(default)
