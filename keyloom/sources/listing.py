"""Files as rows, empty ones too: a data source that lists folders in tasks.

Spark's file readers leave empty files out, so the sources that owe a row for each file ask this
one. A listed path is a file, a folder or a glob. Of a folder come the files right in it and, of
its ``key=value`` folders, all below, as Spark's readers take them. Each such folder is a
partition, listed by its own task; no table of paths is made on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import translate

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "keyloom_listing"
SCHEMA = "path string, length bigint, modified timestamp"
ROWS = 10_000
_WILD = re.compile(r"[*?\[{]")


def open_uri(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what to put before a path of it)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        uri = "file://" + uri
    scheme, rest = uri.split("://", 1)
    # the Hadoop name of a store that Arrow knows by another
    known = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if known == "file":
        return pafs.LocalFileSystem(), rest, "file:"
    system, path = pafs.FileSystem.from_uri(f"{known}://{rest}")
    host = "" if known in ("s3", "gs") else rest.split("/", 1)[0]
    return system, path, f"{scheme}://{host}"


def alternatives(pattern: str) -> list[str]:
    """A glob without braces for each choice of theirs."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if found is None:
        return [pattern]
    head, tail = pattern[: found.start()], pattern[found.end() :]
    return list(dict.fromkeys(p for choice in found[1].split(",") for p in alternatives(head + choice + tail)))


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def expand(system: pafs.FileSystem, pattern: str) -> list[pafs.FileInfo]:
    """Files and folders that a glob names, going down only where its parts match."""
    parts = pattern.strip("/").split("/")
    plain = next((i for i, p in enumerate(parts) if _WILD.search(p)), len(parts))
    lead = "/" if pattern.startswith("/") else ""
    found = [system.get_file_info(lead + "/".join(parts[:plain]))]
    for part in parts[plain:]:
        match = re.compile(translate(part)).match
        folders = [f.path for f in found if f.type == pafs.FileType.Directory]
        inside = [x for f in folders for x in system.get_file_info(pafs.FileSelector(f))]
        found = [x for x in inside if match(x.base_name) and not hidden(x.base_name)]
    return [f for f in found if f.type != pafs.FileType.NotFound]


@dataclass
class Folder(InputPartition):
    uri: str
    deep: bool  # a key=value folder, with all below

    def __init__(self, uri: str, deep: bool) -> None:
        super().__init__(None)
        self.uri, self.deep = uri, deep


class ListingReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]) -> None:
        self.paths = list(paths)

    def partitions(self) -> list[InputPartition]:
        """The named files and folders, and the ``key=value`` folders right below."""
        found = []
        for uri in self.paths:
            system, path, before = open_uri(uri)
            for pattern in alternatives(path):
                for info in expand(system, pattern):
                    found.append(Folder(before + info.path, False))
                    if info.type == pafs.FileType.Directory:
                        inside = system.get_file_info(pafs.FileSelector(info.path))
                        found += [Folder(before + x.path, True) for x in inside if self._below(x)]
        return found or [Folder("", False)]

    @staticmethod
    def _below(info: pafs.FileInfo) -> bool:
        return info.type == pafs.FileType.Directory and "=" in info.base_name and not hidden(info.base_name)

    def _files(self, system: pafs.FileSystem, info: pafs.FileInfo, deep: bool) -> Iterator[pafs.FileInfo]:
        if info.type == pafs.FileType.File:
            yield info
            return
        for x in system.get_file_info(pafs.FileSelector(info.path)):
            if x.type == pafs.FileType.File and not hidden(x.base_name):
                yield x
            elif deep and self._below(x):
                yield from self._files(system, x, True)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
        system, path, before = open_uri(partition.uri)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for f in self._files(system, system.get_file_info(path), partition.deep):
            rows.append((before + f.path, f.size, f.mtime))
            if len(rows) == ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ListingReader:
        count = int(self.options["count"])
        return ListingReader([self.options[f"path{i}"] for i in range(count)])


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length, modified): every file, empty ones too, of files, folders and globs."""
    spark.dataSource.register(Listing)
    reader = spark.read.format(NAME).option("count", str(len(paths)))
    for i, path in enumerate(paths):
        reader = reader.option(f"path{i}", path)
    return reader.load()
