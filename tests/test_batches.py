"""Combiners over columns against plain groups: odd keys, many batches, hot keys, merges in levels."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest

from keyloom.operators import batches, combine, udfs


def create(starts, c):
    x = np.asarray(c["x"])
    return {"total": np.add.reduceat(x, starts), "n": np.diff(np.append(starts, len(x))), "top": np.maximum.reduceat(x, starts)}


def merge(starts, c):
    return {
        "total": np.add.reduceat(c["total"], starts), "n": np.add.reduceat(c["n"], starts),
        "top": np.maximum.reduceat(c["top"], starts),
    }


COMBINER = "total long, n long, top long"


@pytest.mark.parametrize("held,map_side,rows_a_batch", [(100_000, True, 10_000), (20, True, 37), (5, False, 3)])
def test_by_key(spark, monkeypatch, held, map_side, rows_a_batch):
    monkeypatch.setattr(batches, "HELD_ROWS", held)
    r = random.Random(3)
    nan = float("nan")
    rows = [
        (r.choice([None, "", "a", "hot", "hot", "hot", "é"]), r.choice([None, 0.0, -0.0, nan, 1.5]), r.randint(-9, 9))
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, f double, x long").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        got = batches.combine_batches_by_key(df, ["k", "f"], create, merge, COMBINER, map_side).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = defaultdict(list)
    for k, f, x in rows:
        want[k, "nan" if f is not None and math.isnan(f) else f if f is None else f + 0.0].append(x)
    found = {(g.k, "nan" if g.f is not None and math.isnan(g.f) else g.f): (g.total, g.n, g.top) for g in got}
    assert len(got) == len(found)
    assert found == {k: (sum(v), len(v), max(v)) for k, v in want.items()}


def test_same_as_rows(spark):
    """The cases of the row form: sums by key, and one value whatever the depth."""
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS x")
    by_rows = combine.combine_by_key(df, "k", lambda v: v["x"], lambda c, v: c + v["x"], lambda a, b: a + b, "long")
    by_batch = batches.combine_batches_by_key(df, "k", create, merge, COMBINER)
    assert {r.k: r.value for r in by_rows.collect()} == {r.k: r.total for r in by_batch.collect()}
    pairs = spark.createDataFrame([(x,) for x in [-1000, *range(-5, 6), 1000]], "x long").repartition(10)
    for depth in range(1, 10):
        assert batches.aggregate_batches(pairs, create, merge, COMBINER, depth) == {"total": 0, "n": 13, "top": 1000}
    assert batches.aggregate_batches(pairs.limit(0), create, merge, COMBINER) is None
    assert batches.combine_batches_by_key(df.limit(0), "k", create, merge, COMBINER).count() == 0


def test_other_types_and_errors(spark):
    """Texts come as Arrow arrays; what a function owes is checked."""
    df = spark.createDataFrame([(1, "b"), (1, None), (2, None), (1, "a")], "k long, s string")

    def first(starts, c):
        import pyarrow as pa

        ends = np.append(starts[1:], len(c["s"]))
        return {"s": pa.array([pc.min(c["s"].slice(a, b - a)).as_py() for a, b in zip(starts, ends)], pa.string())}

    got = batches.combine_batches_by_key(df, "k", first, first, "s string").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="one value a group"):
        batches.combine_batches_by_key(df, "k", lambda s, c: {"s": ["x"] * 9}, first, "s string").collect()
    with pytest.raises(Exception, match="gave no column"):
        batches.combine_batches_by_key(df, "k", lambda s, c: {}, first, "s string").collect()


def test_table_function_over_batches(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (None, "c", None)], "k long, s string, o string")

    def split(texts):
        lists = pc.split_pattern(texts, " ")
        return pc.list_parent_indices(lists), [pc.list_flatten(lists), pc.utf8_length(pc.list_flatten(lists))]

    got = udfs.table_function_batches(df, split, "s", "w string, n long", ["o", "s", "k"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("x", "a b", 1, "a", 1), ("x", "a b", 1, "b", 1), ("z", "", 3, "", 0), (None, "c", None, "c", 1)], key=repr
    )
    assert udfs.table_function_batches(df.limit(0), split, "s", "w string, n long").count() == 0


def test_groups_as_arrow_tables(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(1, 2.0), (None, 5.0), (1, 4.0), (None, 7.0), (3, None)], "k long, v double")

    def mean(g):
        return pa.table({"k": g["k"].slice(0, 1), "v": pa.array([pc.mean(g["v"]).as_py()], pa.float64())})

    got = udfs.map_groups_arrow(df, "k", mean, "k long, v double").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 3.0), (None, 6.0), (3, None)], key=repr)
