"""PageRank on a directed graph."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.persistence import checkpoint
from ..plans.checks import require
from ..plans.shared import materialise
from ..plans.skew import PART, PARTS, ROWS_PER_TASK, hot_from_counts, split_hot, with_parts

CHECKPOINT_EVERY = 5


def edges_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(source, target) from lines of two names separated by white space."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(parts[0].alias("source"), parts[1].alias("target"))


def pagerank(
    edges: DataFrame, iterations: int = 10, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(node, rank) after a fixed number of rounds over the distinct edges.

    Every source starts at 1.0. A round gives each target 0.15 + 0.85 times the sum of what
    its sources pass on, their rank divided by their number of targets. A node nothing
    points to leaves the ranks; a node without out-links keeps its rank and passes nothing.

    The links are prepared once: distinct, with the out-degree on each edge, and with the
    edges of a node of very many links split into parts.
    """
    require(iterations >= 0, "iterations must not be negative")
    distinct = materialise(
        edges.select("source", "target").filter("source is not null").distinct(), "edges"
    )
    degrees = materialise(distinct.groupBy("source").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    hot = hot_from_counts(degrees, ["source"], "degree", rows_per_task)
    keys = ["source"] if hot is None else ["source", PART]
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Placed by join key once and kept, so a round shuffles only what the nodes pass on. The
    # fixed number of partitions is what the aggregation of each round uses as well.
    links = split_hot(distinct, ["source"], hot).join(degrees, "source")
    links = links.select(*keys, "target", "degree").repartition(width, *keys)
    links = links.persist(StorageLevel.MEMORY_AND_DISK)
    links.count()
    ranks = degrees.select(F.col("source").alias("node"), F.lit(1.0).alias("rank"))
    for round_number in range(1, iterations + 1):
        givers = ranks.withColumnRenamed("node", "source")
        if hot is not None:
            parts = F.explode(F.sequence(F.lit(0), F.col(PARTS) - 1))
            givers = with_parts(givers, ["source"], hot).select("source", "rank", parts.alias(PART))
        passed = links.join(givers, keys).select(
            F.col("target").alias("node"), (F.col("rank") / F.col("degree")).alias("given")
        )
        ranks = passed.groupBy("node").agg((0.15 + 0.85 * F.sum("given")).alias("rank"))
        if round_number % CHECKPOINT_EVERY == 0 and round_number < iterations:
            ranks = checkpoint(ranks)
    return ranks
