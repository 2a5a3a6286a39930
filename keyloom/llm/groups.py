"""Comparing the members of key groups in bounded memory, however large a group is.

Rows are dealt by key and sorted, so that a task sees each group as a run. Runs of up to
``block`` rows are compared where they are. Longer ones are passed on in blocks; a second step
deals out pairs of blocks, so that no task holds more than two blocks of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import materialise

# starts of runs, the chunk's columns -> columns of links
Within = Callable[[np.ndarray, pa.Table], dict]
# two blocks of one group -> columns of links
Across = Callable[[pa.Table, pa.Table], dict]


def starts_of(chunk: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a run of equal keys begins."""
    new = np.zeros(len(chunk), bool)
    new[:1] = True
    for k in keys:
        v = chunk.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, longest: int | None) -> Iterator[pa.Table]:
    """Chunks of about ``rows`` rows that end with a run; a run beyond ``longest`` is cut there."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        chunk = pa.concat_tables(held).combine_chunks()
        last = int(starts_of(chunk, keys)[-1])
        if last > 0:
            yield chunk.slice(0, last)
            chunk = chunk.slice(last).combine_chunks()
        if longest:
            while len(chunk) > 2 * longest:
                yield chunk.slice(0, longest)
                chunk = chunk.slice(longest)
        held, n = [chunk], len(chunk)
    if n:
        yield pa.concat_tables(held).combine_chunks()


def compare(
    rows: DataFrame, key: str, within: Within, across: Across, links: str, block: int = 2048, tag: str = "links",
    chunk: int = 50_000,
) -> DataFrame:
    """Links found inside the groups of ``rows`` by the long column ``key``.

    ``within`` and ``across`` return the columns of the schema ``links``. A link may come from
    several groups.
    """
    spark = rows.sparkSession
    names, size = list(rows.columns), chunk
    found = spark.createDataFrame([], links).schema
    both = found.fieldNames()
    rest = rows.schema
    out = links + ", __block long, " + ", ".join(f"__{f.name} {f.dataType.simpleString()}" for f in rest)
    first_schema, second_schema = schema_of(out), schema_of(links)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = first_schema
        key_now, block_now = None, 0
        for chunk in whole_runs(batches, [key], size, block):
            starts = starts_of(chunk, [key])
            sizes = np.diff(np.append(starts, len(chunk)))
            keys = chunk.column(key).to_numpy()
            long_run = sizes > block
            # a run that was cut goes on in the next chunk: its parts are blocks too
            ends = keys[starts]
            if key_now is not None and len(ends) and ends[0] == key_now:
                long_run[0] = True
            if len(starts) == 1 and len(chunk) == block:
                long_run[0] = True
            for s, n in zip(starts[long_run], sizes[long_run], strict=True):
                k = keys[s]
                if k != key_now:
                    key_now, block_now = k, 0
                for at in range(s, s + n, block):
                    part = chunk.slice(at, min(block, s + n - at))
                    yield from as_batches(
                        {"__block": np.full(len(part), block_now, np.int64)}
                        | {f"__{c}": part.column(c) for c in names},
                        len(part), target,
                    )
                    block_now += 1
            small = np.repeat(~long_run, sizes)
            if small.any():
                chosen = chunk if small.all() else chunk.filter(pa.array(small))
                result = within(starts_of(chosen, [key]), chosen)
                n = len(next(iter(result.values())))
                if n:
                    yield from as_batches(result, n, target)

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key)
    passed = materialise(dealt.mapInArrow(first, out), tag)
    large = passed.filter("__block is not null").select(
        F.col("__block").alias("block"), *[F.col(f"__{c}").alias(c) for c in names]
    )
    counts = large.groupBy(F.col(key).alias("of_key")).agg((F.max("block") + 1).alias("blocks"))
    paired = (
        large.join(counts, F.col(key) == F.col("of_key"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *names)
    )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = second_schema
        for chunk in whole_runs(batches, [key, "lo", "hi"], 1, None):
            starts = np.append(starts_of(chunk, [key, "lo", "hi"]), len(chunk))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = chunk.slice(s, e - s)
                lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
                if lo == hi:
                    result = within(np.zeros(1, np.int64), part.combine_chunks())
                else:
                    own = part.column("block").to_numpy() == lo
                    result = across(part.filter(pa.array(own)), part.filter(pa.array(~own)))
                n = len(next(iter(result.values())))
                if n:
                    yield from as_batches(result, n, target)

    crossed = paired.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi").mapInArrow(second, links)
    return passed.filter("__block is null").select(*both).unionByName(crossed)


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def as_batches(columns: dict, n: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``schema``; columns that are not given are null."""
    n = len(next(iter(columns.values()))) if n is None else n
    arrays = []
    for field in schema:
        given = columns.get(field.name)
        if given is None:
            arrays.append(pa.nulls(n, field.type))
        elif isinstance(given, (pa.Array, pa.ChunkedArray)):
            arrays.append(given.cast(field.type) if given.type != field.type else given)
        else:
            arrays.append(pa.array(given, field.type))
    yield from pa.table(arrays, schema=schema).to_batches()


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index of a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 512):
            new[at : at + 512] = np.minimum(
                new[at : at + 512], np.where(adjacent[at : at + 512], label[None, :], n).min(1)
            )
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
