"""Word count over the text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import reduce_by_key
from ..operators.project import flat_map
from ..plans.keys import quoted


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, count): split at single spaces, empty words included, counted before the shuffle."""
    words = flat_map(lines, F.split(F.col(quoted(column)), " "), "word")
    return reduce_by_key(words, "word", count=F.count(F.lit(1)))
