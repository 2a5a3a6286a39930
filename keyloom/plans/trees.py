"""Shape of multi-level merges."""

from __future__ import annotations

import math

from .checks import require


def merge_levels(count: int, depth: int) -> list[int]:
    """Partials kept after each intermediate level, at most ``depth - 1`` of them.

    Every level divides the number of partials by the ``depth``-th root of ``count``.
    """
    require(depth >= 1, f"depth must be at least 1, not {depth}")
    fan_in = max(2, round(count ** (1 / depth)))
    sizes = [math.ceil(count / fan_in**level) for level in range(1, depth)]
    return [size for size in sizes if size > 1]
