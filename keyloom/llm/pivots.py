"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest pivots in order. Its inverted lists are those of every two
pivots of the description, so vectors that meet in a list share two pivots at least; the exact
cosine in double precision then decides. A pair that meets in several lists is counted in the
first list they share.

Pivots come from a bounded sample (``SAMPLE`` vectors, taken by hash), spread out by farthest
points; every vector is indexed. Equal vectors enter the index once with their number. Lists are
compared in blocks, and give out link counts and one link per vector to the smallest vector it
is connected with in the list, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.prefix import FILE, ROW, numbered_files
from keyloom.plans.shared import materialise

from . import groups
from .components import components

SAMPLE = 4096
PIVOTS = 256
DESCRIBED_BY = 7
# Pivots are at most this similar to each other.
APART = 0.7
MIN_COSINE = 0.9


def valid(v: Column) -> Column:
    """Has components, none of them null, infinite or NaN, and not all of them zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(~bad & some, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(classes: DataFrame, sample: int, pivots: int) -> dict[int, np.ndarray]:
    """Pivots by dimension, from at most ``sample`` vectors of the smallest hashes."""
    rows = classes.orderBy(F.xxhash64("vec"), "vec").limit(sample).select("vec").collect()  # bounded by ``sample``
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    chosen = {}
    for dim, vectors in by.items():
        x = units(np.array(vectors, np.float64))
        picks, nearest = [0], x @ x[0]
        while len(picks) < min(pivots, len(x)):
            far = int(np.argmin(nearest))
            if nearest[far] > APART:
                break  # pivots side by side would split what belongs together
            picks.append(far)
            nearest = np.maximum(nearest, x @ x[far])
        chosen[dim] = x[picks]
    return chosen


def lists_of(nearest: np.ndarray, pivots: int) -> np.ndarray:
    """Numbers of the inverted lists: every two pivots of each (sorted) description."""
    i, j = np.triu_indices(nearest.shape[1], 1)
    return nearest[:, i] * pivots + nearest[:, j]


def index(classes: DataFrame, pivots: dict[int, np.ndarray], described_by: int, number: int) -> DataFrame:
    """(key, cid, n, near, vec): a row for each inverted list of each vector."""
    kind = classes.schema["vec"].dataType.simpleString()
    ddl = f"key long, cid long, n long, near array<int>, vec {kind}"
    schema = groups.schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("vec").offsets.to_numpy())
            for dim in np.unique(size):
                rows = pa.Table.from_batches([batch]).filter(pa.array(size == dim)).combine_chunks()
                x = units(matrix(rows.column("vec")))
                # a dimension that the sample has missed is one list
                p = pivots.get(int(dim))
                if p is None or len(p) < 2:
                    near = np.zeros((len(x), 2), np.int64)
                    near[:, 1] = 1
                else:
                    k = min(described_by, len(p))
                    near = np.sort(np.argpartition(-(x @ p.T), k - 1, 1)[:, :k], 1)
                keys = lists_of(near, number) + int(dim) * number * number
                times = keys.shape[1]
                at = np.repeat(np.arange(len(x)), times)
                flat = pa.array(near.astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), flat)
                for s in range(0, len(at), 50_000):
                    some = pa.array(at[s : s + 50_000])
                    yield from groups.as_batches(
                        {
                            "key": keys.ravel()[s : s + 50_000],
                            "cid": rows.column("cid").take(some),
                            "n": rows.column("n").take(some),
                            "near": lists.take(some),
                            "vec": rows.column("vec").take(some),
                        },
                        len(some), schema,
                    )

    return classes.select("cid", "n", "vec").mapInArrow(run, ddl)


def comparers(min_cosine: float, number: int):
    def first_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first list that two descriptions share, as pivot * number + pivot."""
        shared = (a[:, :, None] == b[:, None, :]).any(2)
        order = np.sort(np.where(shared, a, number), 1)
        return order[:, 0] * number + order[:, 1]

    def links(x, y, near_x, near_y, key, upper):
        """Pairs of rows with enough cosine, and whether this list is their first."""
        for at in range(0, len(x), 256):
            hit = x[at : at + 256] @ y.T >= min_cosine
            i, j = np.nonzero(hit)
            i += at
            if upper:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 200_000):
                p, q = i[s : s + 200_000], j[s : s + 200_000]
                yield p, q, first_list(near_x[p], near_y[q]) == key

    def collected(cid, n, pairs) -> dict:
        size = len(cid)
        peers = np.zeros(size, np.int64)
        adjacent = np.zeros((size, size), bool)
        for p, q, first in pairs:
            adjacent[p, q] = adjacent[q, p] = True
            np.add.at(peers, p[first], n[q[first]])
            np.add.at(peers, q[first], n[p[first]])
        root = groups.roots(adjacent)
        told = np.flatnonzero((peers > 0) | (root != np.arange(size)))
        return {"a": cid[told], "b": cid[root[told]], "peers": peers[told]}

    def parts(t: pa.Table):
        near = matrix(t.column("near")).astype(np.int64)
        return t.column("cid").to_numpy(), t.column("n").to_numpy(), near, units(matrix(t.column("vec")))

    def within(starts: np.ndarray, chunk: pa.Table) -> dict:
        keys = chunk.column("key").to_numpy() % (number * number)
        out: dict[str, list] = {"a": [], "b": [], "peers": []}
        for s, e in zip(starts, np.append(starts[1:], len(chunk)), strict=True):
            if e - s < 2:
                continue
            cid, n, near, x = parts(chunk.slice(s, e - s))
            found = collected(cid, n, links(x, x, near, near, keys[s], True))
            for c in out:
                out[c].append(found[c])
        return {c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in out.items()}

    def across(one: pa.Table, two: pa.Table) -> dict:
        key = one.column("key")[0].as_py() % (number * number)
        cid, n, near, x = parts(one)
        cid2, n2, near2, y = parts(two)
        pairs = ((p, q + len(cid), f) for p, q, f in links(x, y, near, near2, key, False))
        return collected(np.concatenate([cid, cid2]), np.concatenate([n, n2]), pairs)

    return within, across


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    sample: int = SAMPLE,
    pivots: int = PIVOTS,
    described_by: int = DESCRIBED_BY,
    block: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components have no links.
    Vectors of different lengths are never linked. Repeated rows are copies and count as links.
    A null id takes part in links; a component's id is the smallest other id, null if none.
    Empty input gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).withColumn("ok", valid(F.col("vec")))
    grouped = rows.filter("ok").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    numbered = numbered_files(grouped)
    classes = numbered.select("vec", "n", "least", (F.shiftleft(F.col(FILE), 40) + F.col(ROW)).alias("cid"))
    chosen = choose_pivots(classes, sample, pivots)
    listed = index(classes, chosen, described_by, pivots)
    within, across = comparers(min_cosine, pivots)
    found = materialise(
        groups.compare(listed, "key", within, across, "a long, b long, peers long", block, "pivots"), "pivots"
    )
    reach = components(found.select("a", "b"), "pivots")
    peers = found.groupBy(F.col("a").alias("p_cid")).agg(F.sum("peers").alias("peers"))
    placed = (
        classes.join(reach, F.col("cid") == F.col("node"), "left")
        .join(peers, F.col("cid") == F.col("p_cid"), "left")
        .select(
            "vec", "least", F.coalesce("root", "cid").alias("root"),
            (F.col("n") - 1 + F.coalesce("peers", F.lit(0))).alias("n_links"),
        )
    )
    placed = materialise(placed, "pivots")
    whole = placed.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component_id"))
    answer = placed.join(whole, F.col("root") == F.col("of_root")).select(
        F.xxhash64("vec").alias("c_hash"), F.col("vec").alias("c_vec"), "n_links", "component_id"
    )
    joined = rows.join(
        answer, (F.xxhash64("vec") == F.col("c_hash")) & (F.col("vec") == F.col("c_vec")) & F.col("ok"), "left"
    )
    own = F.when(F.col("c_hash").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
