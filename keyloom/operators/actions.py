"""Actions to the driver, asynchronous actions and job groups."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession


def collect(df: DataFrame) -> list[Row]:
    """All rows; only for results known to fit in the driver."""
    return df.collect()


def local_iterator(df: DataFrame, prefetch: bool = False) -> Iterator[Row]:
    """All rows, one partition at a time: the driver holds one partition, or two."""
    return df.toLocalIterator(prefetch)


class FutureAction:
    """A running action: result, cancellation, status and the ids of its jobs."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any]) -> None:
        self._sc = spark.sparkContext
        self.tag = f"action-{uuid.uuid4().hex}"
        self._value: Any = None
        self._error: BaseException | None = None
        self._cancelled = False
        self._done = threading.Event()

        def run() -> None:
            self._sc.addJobTag(self.tag)
            self._sc.setJobGroup(self.tag, "asynchronous action", interruptOnCancel=False)
            try:
                self._value = action()
            except BaseException as error:  # noqa: BLE001 - raised again in result()
                self._error = error
            finally:
                self._sc.removeJobTag(self.tag)
                self._done.set()

        InheritableThread(target=run, daemon=True).start()

    def cancel(self) -> None:
        self._cancelled = True
        self._sc.cancelJobsWithTag(self.tag)

    @property
    def is_cancelled(self) -> bool:
        return self._cancelled and self._done.is_set() and self._error is not None

    @property
    def is_completed(self) -> bool:
        return self._done.is_set()

    def job_ids(self) -> list[int]:
        return sorted(self._sc.statusTracker().getJobIdsForGroup(self.tag))

    def ready(self, timeout: float | None = None) -> FutureAction:
        if not self._done.wait(timeout):
            raise TimeoutError("the action is still running")
        return self

    def result(self, timeout: float | None = None) -> Any:
        self.ready(timeout)
        if self._error is not None:
            raise self._error
        return self._value


def count_async(df: DataFrame) -> FutureAction:
    return FutureAction(df.sparkSession, df.count)


def collect_async(df: DataFrame) -> FutureAction:
    return FutureAction(df.sparkSession, df.collect)


def take_async(df: DataFrame, n: int) -> FutureAction:
    return FutureAction(df.sparkSession, lambda: df.take(n))


def foreach_async(df: DataFrame, effect: Callable[[Row], None]) -> FutureAction:
    return FutureAction(df.sparkSession, lambda: df.foreach(effect))


def foreach_partition_async(
    df: DataFrame, effect: Callable[[Iterable[Row]], None]
) -> FutureAction:
    return FutureAction(df.sparkSession, lambda: df.foreachPartition(effect))


@contextmanager
def job_group(
    spark: SparkSession, name: str, description: str = "", interrupt: bool = False
) -> Iterator[None]:
    """Jobs started inside the block belong to the group."""
    sc = spark.sparkContext
    sc.setJobGroup(name, description, interrupt)
    try:
        yield
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def cancel_group(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def cancel_all(spark: SparkSession) -> None:
    spark.sparkContext.cancelAllJobs()
