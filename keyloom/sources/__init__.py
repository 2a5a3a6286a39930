"""Datasets from local values, files, Hadoop formats and JDBC."""

from .files import (
    binary_files,
    input_splits,
    object_file,
    text_file,
    text_stream,
    whole_text_files,
)
from .fixed import fixed_records
from .hadoop import hadoop_file, hadoop_rdd, new_hadoop_file, new_hadoop_rdd, sequence_file
from .jdbc import jdbc_range_scan, range_predicates
from .listing import list_files
from .local import empty, from_rows, range_source

__all__ = [
    "binary_files",
    "empty",
    "fixed_records",
    "from_rows",
    "hadoop_file",
    "hadoop_rdd",
    "input_splits",
    "jdbc_range_scan",
    "list_files",
    "new_hadoop_file",
    "new_hadoop_rdd",
    "object_file",
    "range_predicates",
    "range_source",
    "sequence_file",
    "text_file",
    "text_stream",
    "whole_text_files",
]
