"""Stage and executor counters kept up to date while logs arrive.

State is one row per stage attempt or executor. The counters do not depend on event time,
so there is no watermark: a late file only adds to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..eventlog import tables as t
from ..plans.shared import settings

STATE_STORE = "spark.sql.streaming.stateStore"
IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STAGE_KEY = ["app_id", "stage_id", "attempt"]


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def stage_counters(events: DataFrame) -> DataFrame:
    """Finished and started tasks and metric sums per stage attempt; batch or streaming."""
    ends = t.of_kind(events, t.TASK_START, t.TASK_END)
    is_end = F.col("Event") == t.TASK_END
    reason = t.field("Task End Reason", "Reason")
    metrics = F.when(reason == t.SUCCESS, F.col("Task Metrics")).when(
        reason == t.EXCEPTION, t.field("Task End Reason", "Metrics")
    )
    rows = ends.select(
        "app_id",
        F.col("Stage ID").alias("stage_id"),
        t.attempt_of(F.col("Stage Attempt ID")),
        is_end.alias("is_end"),
        reason.alias("reason"),
        F.when(is_end, metrics).alias("metrics"),
    )
    return rows.groupBy(*STAGE_KEY).agg(
        _count_if(~F.col("is_end")).alias("num_started"),
        _count_if(F.col("is_end") & (F.col("reason") == t.SUCCESS)).alias("num_complete"),
        _count_if(F.col("is_end") & (F.col("reason") != t.SUCCESS)).alias("num_failed"),
        *[
            F.coalesce(F.sum(t.counter("metrics", n)), F.lit(0)).alias(n)
            for n in ("executor_run_time", "shuffle_read_bytes", "shuffle_write_bytes")
        ],
    )


def executor_counters(events: DataFrame) -> DataFrame:
    """Finished tasks and time per executor; batch or streaming."""
    ends = t.task_ends(events).filter(F.col("reason") != t.RESUBMITTED)
    return ends.groupBy("app_id", "executor_id").agg(
        _count_if(F.col("reason") == t.EXCEPTION).alias("failed_tasks"),
        _count_if(F.col("reason") != t.EXCEPTION).alias("completed_tasks"),
        F.sum("duration").alias("total_duration"),
    )


def start_counters(
    counters: DataFrame, checkpoint: str, table_path: str, available_now: bool = True
) -> StreamingQuery:
    """Keep the newest state of every counter as Parquet, one folder per micro-batch.

    Each batch writes only the rows that changed; ``latest_counters`` reads the newest row
    of each key. A batch that runs again replaces its own folder.

    State is kept on disk, unless the session names a store of its own: Spark's default holds it in
    memory and copies it whole for each batch. A stream that goes on keeps the store it began with.
    """
    spark = counters.sparkSession
    ours = {f"{STATE_STORE}.providerClass": ON_DISK, f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true"}
    if spark.conf.get(f"{STATE_STORE}.providerClass", IN_MEMORY) != IN_MEMORY:
        ours = {}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    writer = (
        counters.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    with settings(spark, ours):
        return writer.start()


def latest_counters(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row of each key from the folders ``start_counters`` wrote."""
    values = [c for c in table.columns if c not in keys and c != "batch"]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col("v")[c].alias(c) for c in values])
