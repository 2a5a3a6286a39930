"""Connected components of a graph of links, by alternating stars.

Each round rewrites the links so that every node points to smaller nodes, until each component
is a star around its smallest node. The number of rounds grows with the logarithm of the size of
a component. All rounds are joins and combined aggregates; each is written to the shared folder,
so a lost executor costs one round at most, and the driver only sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import materialise


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("of", F.least("of", "least").alias("least"))
    greater = both.filter("v > u")
    return greater.join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select(F.col("of").alias("u"), F.col("least").alias("v")))


def _clean(links: DataFrame) -> DataFrame:
    return links.filter("u != v").distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node that has a link; ``links`` has two long columns.

    ``root`` is the smallest node reachable. Links with a null end, self-links and repeats are
    ignored; no links give no rows.
    """
    a, b = links.columns
    now = materialise(
        _clean(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())),
        tag,
    )
    mark = _mark(now)
    while mark[0]:
        now = materialise(_clean(_small_star(_clean(_large_star(now)))), tag)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    """Count and checksum of a set of links."""
    wide = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(wide)).first())
