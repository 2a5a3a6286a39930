"""Storage that every executor can reach.

Lineage is cut by writing to the shared folder named in ``spark.checkpoint.dir``; results
there survive the loss of any executor. Only a local session without that setting gets a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
    own = tempfile.mkdtemp(prefix="keyloom-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without replacing a folder the cluster set."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = shared_dir(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def discard_on_exit(spark: SparkSession, path: str) -> None:
    """Let the file system drop a scratch table when the driver ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    jvm_path.getFileSystem(conf).deleteOnExit(jvm_path)


def discard(spark: SparkSession, path: str) -> None:
    """Drop a scratch table that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def lean_writes(spark: SparkSession, folders: int = 32, fields: int | None = None) -> Iterator[None]:
    """Writes in here take little room beside their files.

    Up to ``folders`` folders are written side by side, so that rows need no sort by folder, which
    spills wide rows; more are sorted as always. Shuffle files go when the write that made them ends.
    Rows of up to ``fields`` fields, nested ones too, are worked on by compiled code.
    """
    names = {
        "spark.sql.maxConcurrentOutputFileWriters": str(folders),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    if fields is not None:
        names["spark.sql.codegen.maxFields"] = str(fields)
    with settings(spark, names):
        yield


@contextmanager
def settings(spark: SparkSession, names: dict[str, str]) -> Iterator[None]:
    """What starts in here does so with these settings; those of before come back."""
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: one pass, stable rows."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    discard_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
