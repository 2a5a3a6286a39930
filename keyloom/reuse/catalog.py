"""Which stored results to drop and which are out of date."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import require
from ..plans.prefix import running
from ..plans.shared import materialise

MAX_AGE_DAYS = 7
# Least useful first: fewer hits, cheaper to recompute, smaller, shorter plan, fewer scans, name.
RANK = ["reuse", "ms", "size_gib", "n_nodes", "n_scans", "path"]


def evict_candidates(
    catalog: DataFrame, capacity_gib: float, needed_gib: float, now: datetime
) -> DataFrame:
    """(id, path, reason): entries to remove so that a new one fits.

    Nothing is removed while there is room. Otherwise entries at least seven days old go
    first, then the least useful until the new entry fits. An entry larger than the whole
    store is refused.
    """
    require(needed_gib <= capacity_gib, "the new entry is larger than the store")
    limit = (now - timedelta(days=MAX_AGE_DAYS)).isoformat(sep=" ")
    limit_column = F.lit(limit).cast(catalog.schema["inserted"].dataType)
    # written, so that the catalog is worked out once
    aged = materialise(catalog.withColumn("__old", F.col("inserted") <= limit_column), "catalog")
    used, fresh_used = aged.agg(
        F.coalesce(F.sum("size_gib"), F.lit(0.0)),
        F.coalesce(F.sum(F.when(~F.col("__old"), F.col("size_gib"))), F.lit(0.0)),
    ).first()
    if used + needed_gib <= capacity_gib:
        return aged.limit(0).select("id", "path", F.lit("").alias("reason"))
    old = aged.filter("__old").select("id", "path", F.lit("age").alias("reason"))
    excess = fresh_used + needed_gib - capacity_gib
    if excess <= 0:
        return old
    fresh = aged.filter(~F.col("__old")).select("id", *RANK)
    ranked = running(fresh, [], RANK, {"freed": ("size_gib", "sum")})
    lowest = ranked.filter(F.col("freed") < excess).select("id", "path", F.lit("rank").alias("reason"))
    return old.unionByName(lowest)


def stale_entries(stored_inputs: DataFrame, current_inputs: DataFrame) -> DataFrame:
    """Ids of entries with an input file that changed or is gone since it was read.

    Both tables have (path, mtime); the stored one also the id of the entry.
    """
    now = current_inputs.select("path", F.col("mtime").alias("__now"))
    return (
        stored_inputs.join(now, "path", "left")
        .filter(F.col("__now").isNull() | (F.col("__now") != F.col("mtime")))
        .select("id")
        .distinct()
    )
