"""Hadoop InputFormats and SequenceFiles.

No DataFrame source reads these, so the RDD reader is used and typed at once. Writables are
converted to Python values by Spark, one copy per record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Conf = Mapping[str, str]


def _typed(spark: SparkSession, rdd, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rdd, schema, verifySchema=False)


def _joined(paths: str | Sequence[str]) -> str:
    return paths if isinstance(paths, str) else ",".join(paths)


def hadoop_file(
    spark: SparkSession,
    paths: str | Sequence[str],
    input_format: str,
    key_class: str,
    value_class: str,
    schema: T.StructType | str,
    conf: Conf | None = None,
) -> DataFrame:
    """Pairs from an InputFormat of the old (``mapred``) API."""
    rdd = spark.sparkContext.hadoopFile(
        _joined(paths), input_format, key_class, value_class, conf=dict(conf or {})
    )
    return _typed(spark, rdd, schema)


def hadoop_rdd(
    spark: SparkSession, input_format: str, key_class: str, value_class: str,
    schema: T.StructType | str, conf: Conf,
) -> DataFrame:
    """As ``hadoop_file`` with everything, paths included, in the configuration."""
    rdd = spark.sparkContext.hadoopRDD(input_format, key_class, value_class, conf=dict(conf))
    return _typed(spark, rdd, schema)


def new_hadoop_file(
    spark: SparkSession,
    paths: str | Sequence[str],
    input_format: str,
    key_class: str,
    value_class: str,
    schema: T.StructType | str,
    conf: Conf | None = None,
) -> DataFrame:
    """Pairs from an InputFormat of the new (``mapreduce``) API."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        _joined(paths), input_format, key_class, value_class, conf=dict(conf or {})
    )
    return _typed(spark, rdd, schema)


def new_hadoop_rdd(
    spark: SparkSession, input_format: str, key_class: str, value_class: str,
    schema: T.StructType | str, conf: Conf,
) -> DataFrame:
    rdd = spark.sparkContext.newAPIHadoopRDD(input_format, key_class, value_class, conf=dict(conf))
    return _typed(spark, rdd, schema)


def sequence_file(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str
) -> DataFrame:
    """Pairs of a SequenceFile; the two fields of ``schema`` name and type them."""
    return _typed(spark, spark.sparkContext.sequenceFile(_joined(paths)), schema)
