"""Keeping results and cutting lineage."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..plans.checks import require
from ..plans.shared import ensure_checkpoint_dir

# The twelve level names and their settings
# (use disk, use memory, use off-heap, deserialized, replication)
LEVELS = {
    "NONE": StorageLevel(False, False, False, False, 1),
    "DISK_ONLY": StorageLevel(True, False, False, False, 1),
    "DISK_ONLY_2": StorageLevel(True, False, False, False, 2),
    "MEMORY_ONLY": StorageLevel(False, True, False, True, 1),
    "MEMORY_ONLY_2": StorageLevel(False, True, False, True, 2),
    "MEMORY_ONLY_SER": StorageLevel(False, True, False, False, 1),
    "MEMORY_ONLY_SER_2": StorageLevel(False, True, False, False, 2),
    "MEMORY_AND_DISK": StorageLevel(True, True, False, True, 1),
    "MEMORY_AND_DISK_2": StorageLevel(True, True, False, True, 2),
    "MEMORY_AND_DISK_SER": StorageLevel(True, True, False, False, 1),
    "MEMORY_AND_DISK_SER_2": StorageLevel(True, True, False, False, 2),
    "OFF_HEAP": StorageLevel(True, True, True, False, 1),
}


def persist(df: DataFrame, level: str = "MEMORY_AND_DISK") -> DataFrame:
    """Keep the rows on the executors. A level that is set cannot be changed."""
    require(level in LEVELS, f"unknown level {level}; known: {sorted(LEVELS)}")
    wanted = LEVELS[level]
    have = df.storageLevel
    require(
        have == LEVELS["NONE"] or have == wanted,
        "the storage level is set already; unpersist first",
    )
    return df.persist(wanted)


def cache(df: DataFrame) -> DataFrame:
    return persist(df)


def unpersist(df: DataFrame, blocking: bool = False) -> DataFrame:
    return df.unpersist(blocking)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write the rows to the checkpoint folder and forget how they were computed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Lineage cut that survives the loss of executors; the same as ``checkpoint``."""
    return checkpoint(df, eager)


def describe_lineage(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text; ``Exchange`` lines are the shuffle boundaries."""
    plan = df._jdf.queryExecution()
    return plan.explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )
