"""Streaming the rows of each partition through an external process."""

from __future__ import annotations

import os
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import require
from .arrow import BATCH_ROWS


def pipe(
    df: DataFrame,
    command: str | Sequence[str],
    line: Column | None = None,
    env: Mapping[str, str] | None = None,
    header: Sequence[str] = (),
    write_row: Callable[[str, Callable[[str], None]], None] | None = None,
    separate_dir: bool = False,
) -> DataFrame:
    """Write each row as a line to the command and return its output lines as ``value``.

    A string command is split into words; no shell is involved. ``header`` lines go first in
    every partition. ``write_row`` may write any number of lines for a row. A non-zero exit
    fails the task. ``separate_dir`` runs each task in an empty folder of its own.
    """
    words = command.split() if isinstance(command, str) else list(command)
    require(bool(words), "the command is empty")
    text = df.columns[0] if line is None else line
    column = F.col(text) if isinstance(text, str) else text
    extra = dict(env or {})
    heads = list(header)
    schema = pa.schema([("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() if separate_dir else _here() as folder:
            process = subprocess.Popen(
                words,
                stdin=subprocess.PIPE,
                stdout=subprocess.PIPE,
                stderr=subprocess.PIPE,
                env={**os.environ, **extra},
                cwd=folder,
                text=True,
                encoding="utf-8",
            )
            problems: list[BaseException] = []
            errors: list[str] = []

            def feed() -> None:
                def put(item: str) -> None:
                    process.stdin.write(item + "\n")

                try:
                    for head in heads:
                        put(head)
                    for batch in batches:
                        for item in batch.column(0).to_pylist():
                            write_row(item, put) if write_row else put("" if item is None else item)
                except BrokenPipeError:
                    pass  # the command stopped reading; its exit code decides
                except BaseException as problem:  # noqa: BLE001 - handed to the task below
                    problems.append(problem)
                finally:
                    try:
                        process.stdin.close()
                    except BrokenPipeError:
                        pass

            def drain() -> None:
                for item in process.stderr:
                    errors.append(item)
                    del errors[:-50]

            threads = [threading.Thread(target=t, daemon=True) for t in (feed, drain)]
            for thread in threads:
                thread.start()
            lines: list[str] = []
            for item in process.stdout:
                lines.append(item.rstrip("\n"))
                if len(lines) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pydict({"value": lines}, schema=schema)
                    lines = []
            code = process.wait()
            for thread in threads:
                thread.join()
            if problems:
                raise problems[0]
            if code != 0:
                raise RuntimeError(f"{words[0]} ended with code {code}: {''.join(errors)}")
            if lines:
                yield pa.RecordBatch.from_pydict({"value": lines}, schema=schema)

    return df.select(column.cast("string").alias("value")).mapInArrow(run, "value string")


class _here:
    """Stands in for a temporary folder when the command runs where the task runs."""

    def __enter__(self) -> None:
        return None

    def __exit__(self, *_: object) -> None:
        return None
