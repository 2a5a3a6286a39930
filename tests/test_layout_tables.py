"""Range sketches, tables with a file index, and bucketed tables that joins take as they are."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import aggregates, bucketed, clustered, joins, layout, sets


def spread(df, key, bounds):
    cuts = sorted(r["key"] for r in bounds.collect())
    got = [0] * (len(cuts) + 1)
    for (value,) in df.select(key).collect():
        if value is not None:
            got[sum(c < value for c in cuts)] += 1
    return got


@pytest.mark.parametrize("case", ["even", "one big partition", "sorted", "one partition"])
def test_sketch_is_balanced(spark, case):
    df = spark.range(20000).select(F.xxhash64("id").alias("key"), "id")
    if case == "one big partition":
        df = layout.custom_partition(df, 16, F.when(F.col("id") % 100 < 97, 3).otherwise(F.col("id") % 16))
    elif case == "sorted":
        df = df.repartitionByRange(16, "key")
    elif case == "one partition":
        df = df.coalesce(1)
    bounds = layout.range_bounds_sketched(df, "key", 10, per_range=100, seed=3)
    got = spread(df, "key", bounds)
    assert len(got) == 10 and max(got) < 3 * min(got)
    if case == "even":  # rows in a fixed order give the same sample again
        again = layout.range_bounds_sketched(df, "key", 10, per_range=100, seed=3)
        assert again.collect() == bounds.collect()


def test_sketch_of_small_and_odd_tables(spark):
    empty = spark.createDataFrame([], "key string")
    assert layout.range_bounds_sketched(empty, "key", 5).count() == 0
    rows = [(None,), ("a",), ("b",), (None,), ("c",)]
    some = spark.createDataFrame(rows, "key string")
    # fewer keys than the sample is meant to have: the exact bounds
    assert sorted(map(tuple, layout.range_bounds_sketched(some, "key", 3).collect())) == sorted(
        map(tuple, layout.range_bounds(some, "key", 3).collect())
    )
    same = spark.range(500).select(F.lit(7).alias("key"))
    assert layout.range_bounds_sketched(same, "key", 4).count() <= 1
    with pytest.raises(ValueError):
        layout.range_bounds_sketched(same, "key", 0)


KEYED = "k long, s string, v double"


@pytest.fixture(scope="module")
def keyed(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(0, 900, 2)]), r.choice([None, "", "a", "é"]), float(i)) for i in range(6000)]
    return spark.createDataFrame(rows, KEYED)


@pytest.mark.parametrize("by", ["range", "hash"])
def test_clustered_lookup(spark, keyed, tmp_path, rows, by):
    path = str(tmp_path / by)
    clustered.write_clustered(keyed, path, "k", files=12, by=by)
    assert clustered.read_clustered(spark, path).count() == 6000
    files = len(clustered.read_clustered(spark, path).inputFiles())
    assert files >= 10
    for key in (None, 0, 444, 898):
        found = clustered.lookup(spark, path, "k", key)
        assert rows(found) == rows(keyed.filter(F.col("k").eqNullSafe(F.lit(key)))) != []
        assert len(found.inputFiles()) <= 2
    assert [len(clustered.lookup(spark, path, "k", k).inputFiles()) for k in (-1, 10**6)] == [0, 0]
    # keys that are not there rarely open a file
    opened = sum(len(clustered.lookup(spark, path, "k", k).inputFiles()) for k in range(1, 61, 2))
    assert opened <= 15
    part = clustered.filter_by_range(spark, path, "k", 100, 130)
    assert rows(part) == rows(keyed.filter("k between 100 and 130"))
    assert by == "hash" or len(part.inputFiles()) <= 2


def test_clustered_by_two_keys(spark, keyed, tmp_path, rows):
    path = str(tmp_path / "two")
    clustered.write_clustered(keyed, path, ["s", "k"], files=8)
    for s, k in [("a", 4), (None, 4), ("", None), (None, None), ("é", 898)]:
        found = clustered.lookup(spark, path, ["s", "k"], [s, k])
        want = keyed.filter(F.col("s").eqNullSafe(F.lit(s)) & F.col("k").eqNullSafe(F.lit(k).cast("long")))
        assert rows(found) == rows(want) and len(found.inputFiles()) <= 2
    with pytest.raises(ValueError):
        clustered.lookup(spark, path, ["s", "k"], "a")
    with pytest.raises(Exception, match="exists"):
        clustered.write_clustered(keyed, path, ["s", "k"])


def test_clustered_append_and_empty(spark, keyed, tmp_path, rows):
    path = str(tmp_path / "more")
    clustered.write_clustered(keyed.filter("k < 400"), path, "k", files=4)
    clustered.write_clustered(keyed.filter("k >= 400"), path, "k", files=4, append=True)
    for key in (10, 500):
        found = clustered.lookup(spark, path, "k", key)
        assert rows(found) == rows(keyed.filter(F.col("k") == key)) and len(found.inputFiles()) <= 2
    assert spark.read.parquet(f"{path}/index").groupBy("file").count().filter("count > 1").count() == 0
    empty = str(tmp_path / "empty")
    clustered.write_clustered(keyed.limit(0), empty, "k", files=2)
    assert clustered.lookup(spark, empty, "k", 3).count() == 0
    assert clustered.filter_by_range(spark, empty, "k", 0, 9).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def tables(spark, tmp_path):
    names = []

    def write(df, key, buckets=6):
        name = f"b_{tmp_path.name}_{len(names)}".replace("-", "_")
        layout_path = str(tmp_path / name)
        bucketed.write_bucketed(df, name, key, buckets, layout_path)
        names.append(name)
        return bucketed.read_bucketed(spark, name)

    yield write
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_bucketed_tables_stay_in_place(spark, tables, keyed, rows):
    a = keyed.select("k", F.col("v").alias("x"))
    b = keyed.select("k", F.col("v").alias("y")).filter("y > 3000")
    in_a, in_b = tables(a, "k"), tables(b, "k")
    assert bucketed.layout_of(in_a) == (["k"], 6) == bucketed.layout_of(in_a.filter("x > 1"))
    both = joins.join(in_a.hint("merge"), in_b, "k", null_safe=False)
    assert exchanges(both) == 0 < exchanges(joins.join(a.hint("merge"), b, "k", null_safe=False))
    assert both.count() == joins.join(a, b, "k", null_safe=False).count() > 0
    summed = aggregates.reduce_by_key(in_a, "k", s=F.sum("x"))
    assert exchanges(summed) == 0 and rows(summed) == rows(aggregates.reduce_by_key(a, "k", s=F.sum("x")))
    united = aggregates.reduce_by_key(sets.union([in_a, in_a]), "k", s=F.sum("x"))
    assert exchanges(united) == 0
    assert rows(united) == rows(aggregates.reduce_by_key(sets.union([a, a]), "k", s=F.sum("x")))


def test_existing_layout_is_used(spark, tables, keyed):
    table = tables(keyed, "k", 5)
    assert layout.hash_partition(table, "k", 5) is table
    assert layout.hash_partition(table, "k", 4) is not table
    placed = layout.hash_partition(keyed, "s", 7)
    assert layout.hash_partition(placed, "s", 7) is placed
    assert layout.default_partitions(keyed, table) == 5
    assert layout.default_partitions(table, placed) == 7
    assert bucketed.layout_of(keyed) is None and bucketed.layout_of(keyed.repartition(3)) is None
    with pytest.raises(ValueError):
        bucketed.write_bucketed(keyed, "none", "k", 0)
