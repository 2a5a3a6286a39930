"""Single operators on literal inputs."""

import math
import operator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom import sources
from keyloom.functions import vectors as v
from keyloom.operators import aggregates, combine, joins, layout, order, persistence, project, sets, udfs
from keyloom.plans.checks import EmptyInputError


@pytest.fixture
def pair(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (4, "w")], "k int, w string")
    return left, right


@pytest.mark.parametrize(
    ("how", "rows"),
    [
        ("inner", [(1, 1, "x"), (1, 2, "x"), (2, 1, "y"), (2, 1, "z")]),
        ("left", [(1, 1, "x"), (1, 2, "x"), (2, 1, "y"), (2, 1, "z"), (3, 1, None)]),
        ("right", [(1, 1, "x"), (1, 2, "x"), (2, 1, "y"), (2, 1, "z"), (4, None, "w")]),
        ("full", [(1, 1, "x"), (1, 2, "x"), (2, 1, "y"), (2, 1, "z"), (3, 1, None), (4, None, "w")]),
    ],
)
def test_joins(pair, how, rows):
    assert sorted((tuple(r) for r in joins.join(*pair, "k", how).collect()), key=repr) == sorted(rows, key=repr)


def test_all_pairs_of_one_key(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k int, v int")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    assert joins.join(left, right, "k").count() == 6
    with pytest.raises(ValueError, match="both sides"):
        joins.join(left, left, "k")


def test_cogroups(spark, pair):
    def sizes(df):
        return {r[0]: tuple(len(side) for side in r[1:]) for r in df.collect()}

    assert sizes(joins.cogroup(list(pair), "k")) == {1: (2, 1), 2: (1, 2), 3: (1, 0), 4: (0, 1)}
    third = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c"), (4, "d")], "k int, x string")
    fourth = spark.createDataFrame([(2, "@")], "k int, y string")
    three = joins.cogroup([*pair, third], "k")
    assert sizes(three) == {1: (2, 1, 1), 2: (1, 2, 0), 3: (1, 0, 1), 4: (0, 1, 2)}
    four = joins.group_with([*pair, third, fourth], "k")
    assert sizes(four) == {1: (2, 1, 1, 0), 2: (1, 2, 0, 1), 3: (1, 0, 1, 0), 4: (0, 1, 2, 0)}


def test_cogroup_keeps_null_values(spark):
    a = spark.createDataFrame([(1, None), (None, "q")], "k int, v string")
    b = spark.createDataFrame([(1, 2)], "k int, w int")
    got = {r["k"]: [x["v"] for x in r["side0"]] for r in joins.cogroup([a, b], "k").collect()}
    assert got == {1: [None], None: ["q"]}


def test_subtracts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "k int, s string")
    right = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert [tuple(r) for r in joins.subtract_by_key(left, right, "k").collect()] == [(1, "a")] * 2
    a = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "v int")
    assert [r[0] for r in sets.subtract(a, b).collect()] == [1]


def test_cartesian_and_broadcast(spark, pair):
    left, right = pair
    other = right.withColumnRenamed("k", "k2")
    assert joins.cartesian(left, other).count() == 16
    assert joins.broadcast_join(left, right, "k", "left").count() == 5
    plan = persistence.describe_lineage(joins.broadcast_join(left, right, "k"))
    assert "BroadcastHashJoin" in plan


def test_lookup(spark):
    df = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (5, 7), (None, 8)], "k int, v int")

    def find(key):
        return sorted(r[0] for r in project.lookup(df, "k", key).collect())

    assert (find(1), find(5), find(-1), find(None)) == ([2], [6, 7], [], [8])


def test_key_value_projections(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (1, "c")], "k int, v string")
    words = project.flat_map_values(df, "k", F.split("v", " "))
    assert sorted(tuple(r) for r in words.collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "")]
    assert sorted(r[0] for r in project.keys_of(df, "k").collect()) == [1, 1, 2]
    assert project.values_of(df, "k").columns == ["v"]
    nested = project.key_by(df, F.length("v"), keep_row=True)
    assert nested.columns == ["key", "row"]
    upper = project.map_function(df, lambda r: (r["k"] + 1, r["v"].upper()), "k int, v string")
    assert (3, "") in [tuple(r) for r in upper.collect()]
    split = project.flat_map_function(df, lambda r: ((w,) for w in r["v"].split()), "w string")
    assert sorted(r[0] for r in split.collect()) == ["a", "b", "c"]


def test_per_partition(spark):
    df = spark.range(0, 40, 1, 4)
    arrays = project.glom(df.filter("id < 20")).collect()
    assert sorted(len(r["rows"]) for r in arrays) == [0, 0, 10, 10]
    kept = project.prune_partitions(df, lambda i: i == 3, 4)
    assert sorted(r[0] for r in kept.collect()) == list(range(30, 40))
    tagged = project.map_partitions_with_index(
        df, lambda i, it: (b.assign(p=i) for b in it), "id long, p int"
    )
    assert {(r["id"] // 10, r["p"]) for r in tagged.collect()} == {(i, i) for i in range(4)}
    draw = project.seeded_generator(5)
    kept = project.filter_with(df, draw, lambda g, b: g.random(len(b)) < 0.5)
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in kept.collect())
    assert 5 < kept.count() < 35
    assert layout.run_on_partitions(df, lambda rows: sum(r[0] for r in rows), [1, 2]) == [145, 245]


def test_python_aggregates(spark):
    df = spark.range(-1000, 1000, 1, 10)
    for depth in range(1, 10):
        assert combine.tree_reduce(df, "id", operator.add, depth) == -1000
        assert combine.tree_aggregate(df, 0, operator.add, operator.add, "bigint", "id", depth) == -1000
    assert combine.fold(df, "id", 0, operator.add) == -1000
    # a zero that is not neutral counts once per partition and once in the merge
    assert combine.fold(df, "id", 1, operator.add) == -1000 + 11
    with pytest.raises(ValueError):
        combine.tree_reduce(df, "id", operator.add, 0)
    empty = df.filter("id > 5000")
    with pytest.raises(EmptyInputError):
        combine.reduce(empty, "id", operator.add)
    assert combine.fold(empty, "id", 0, operator.add) == 0
    rows = combine.aggregate(df, 0, lambda n, row: n + (row["id"] > 0), operator.add, "bigint")
    assert rows == 999


def test_python_by_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (3, 2), (5, 1), (5, 3), (None, 4)], "k int, v int").repartition(4)
    sets_ = combine.aggregate_by_key(
        df, "k", [], lambda acc, r: sorted({*acc, r["v"]}), lambda a, b: sorted({*a, *b}), "array<int>"
    )
    assert {r["k"]: list(r["value"]) for r in sets_.collect()} == {1: [1], 3: [2], 5: [1, 3], None: [4]}
    for map_side in (True, False):
        total = combine.combine_by_key(
            df, "k", lambda r: r["v"], lambda c, r: c + r["v"], operator.add, "bigint", map_side
        )
        assert {r["k"]: r["value"] for r in total.collect()} == {1: 2, 3: 2, 5: 4, None: 4}
    arrays = spark.createDataFrame([([1, 2], 1), ([1, 2], 5), ([3], 1)], "k array<int>, v int")
    got = combine.combine_by_key(arrays, "k", lambda r: r["v"], lambda c, r: c + r["v"], operator.add, "bigint")
    assert {tuple(r["k"]): r["value"] for r in got.collect()} == {(1, 2): 6, (3,): 1}


def test_built_in_by_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 2), ("c", 5), ("a", 3)], "s string, v int")
    assert aggregates.reduce_by_key_locally(df, "s", F.sum("v")) == {"a": 6, "b": 2, "c": 5}
    fold = aggregates.fold_by_key(df, "s", "v", 0)
    assert aggregates.as_map(fold, "s", "v") == {"a": 6, "b": 2, "c": 5}
    assert aggregates.as_map(aggregates.count_by_key(df, "s"), "s", "count") == {"a": 3, "b": 1, "c": 1}
    last = aggregates.collect_as_map(df, "s", "v", "v")
    assert aggregates.as_map(last, "s", "v") == {"a": 3, "b": 2, "c": 5}
    groups = {r["key"]: sorted(x["v"] for x in r["values"]) for r in aggregates.group_by(df, F.col("v") % 2).collect()}
    assert groups == {1: [1, 3, 5], 0: [2, 2]}
    values = aggregates.count_by_value(spark.createDataFrame([(1.0,), (float("nan"),), (float("nan"),)], "v double"))
    assert sorted(r["count"] for r in values.collect()) == [1, 2]


def test_empty_inputs(spark):
    none = sources.empty(spark, "v double")
    row = aggregates.stats(none, "v").first()
    assert (row["count"], row["mean"], row["sum"], row["max"], row["min"]) == (0, 0, 0, -math.inf, math.inf)
    assert all(math.isnan(row[c]) for c in ("variance", "stdev", "sample_variance", "sample_stdev"))
    one = aggregates.stats(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert one["variance"] == 0 and math.isnan(one["sample_variance"])
    assert aggregates.sum_double(none, "v").first()["sum"] == 0.0
    assert aggregates.is_empty(none)
    with pytest.raises(Exception, match="empty collection"):
        aggregates.max_min(none, "v").collect()
    with pytest.raises(EmptyInputError):
        order.first(none)
    assert order.take_ordered(none, 3, "v").count() == 0


def test_max_by_other_order(spark):
    df = spark.createDataFrame([("aaa",), ("b",), ("cc",)], "s string")
    assert tuple(aggregates.max_min(df, "s", F.length("s")).first()) == ("aaa", "b")


def test_order(spark):
    df = spark.range(1, 1000, 1, 5)
    for n in (0, 1, 3, 500, 999, 1000):
        assert [r[0] for r in order.take(df, n, "id").collect()] == list(range(1, 1000))[:n]
        assert order.take(df, n).count() == min(n, 999)
    ten = spark.createDataFrame([(i,) for i in range(1, 11)], "v int")
    assert [r[0] for r in order.top(ten, 5, "v").collect()] == [10, 9, 8, 7, 6]
    assert [r[0] for r in order.take_ordered(ten, 5, "v").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        order.top(ten, -1, "v")
    data = spark.createDataFrame([(1, 0), (2, 0), (0, 0), (3, 0)], "k int, v int")
    assert [r[0] for r in order.sort_by_key(data, "k").collect()] == [0, 1, 2, 3]
    assert [r[0] for r in order.sort_by_key(data, "k", ascending=False, num_partitions=9).collect()] == [3, 2, 1, 0]


def test_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (3,), (None,)], "v int")
    assert sets.union([a, b, a]).count() == 11
    assert sorted((r[0] is not None, r[0] or 0) for r in sets.intersection(a, b).collect()) == [(False, 0), (True, 1)]
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "v double")
    assert sets.distinct(zeros).count() == 2


def test_layout(spark):
    df = spark.range(0, 100, 1, 4)
    assert layout.partition_count(layout.repartition(df, 7)) == 7
    assert layout.partition_count(layout.coalesce(df, 2)) == 2
    assert layout.partition_count(layout.coalesce(df, 9)) == 4
    assert layout.partition_count(layout.coalesce(df, 9, shuffle=True)) == 9
    placed = layout.custom_partition(df, 3, F.col("id") % 3)
    parts = placed.select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r["p"] == r["id"] % 3 for r in parts)
    assert layout.default_partitions(df, layout.repartition(df, 9)) in (8, 9)
    down = layout.range_partition(df, "id", 4, ascending=False)
    tops = {r["p"]: r["m"] for r in down.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("m")).collect()}
    assert [tops[i] for i in sorted(tops)] == sorted(tops.values(), reverse=True)


def test_sources(spark):
    df = sources.from_rows(spark, [(i,) for i in range(10)], "v int", 3)
    parts = {}
    for r in df.select("v", F.spark_partition_id().alias("p")).collect():
        parts.setdefault(r["p"], []).append(r["v"])
    assert parts == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8, 9]}
    assert [r[0] for r in sources.range_source(spark, 10, 0, -3).collect()] == [10, 7, 4, 1]
    with pytest.raises(ValueError):
        sources.range_source(spark, 0, 10, 0)
    big = 2**62
    assert sources.range_source(spark, -big, big, big // 2, 2).count() == 4
    assert sources.range_predicates("ID", 1, 100, 3) == [
        "ID >= 1 AND ID <= 33", "ID >= 34 AND ID <= 66", "ID >= 67 AND ID <= 100",
    ]
    huge = sources.range_predicates("ID", 1131544775, 567279358897692673, 20)
    assert huge[-1].endswith("567279358897692673")
    with pytest.raises(ValueError):
        sources.range_predicates("ID", 1, 100, 0)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")

    def value(column):
        return df.select(column.alias("x")).first()["x"]

    assert value(v.add("a", "b")) == [5, 7, 9]
    assert value(v.subtract("b", "a")) == [3, 3, 3]
    assert value(v.dot("a", "b")) == 32
    assert value(v.plus_dot("a", [1, 1, 1], "b")) == 47
    assert value(v.dist("a", "b")) == math.sqrt(27)
    assert value(v.divide(v.negate(v.multiply("a", 2)), 4)) == [-0.5, -1, -1.5]
    assert value(v.divide(v.negate("a"), 0)) == [-math.inf] * 3
    assert math.isnan(value(v.divide(v.zeros(1), 0))[0])
    assert value(v.fill(3, lambda i: i + 1)) == [1, 2, 3]
    assert value(v.fill(0, lambda i: i)) == []
    assert value(v.zeros(2)) == [0, 0] and value(v.ones(2)) == [1, 1]
    drawn = value(v.random(4, 3))
    assert len(drawn) == 4 and all(0 <= x < 1 for x in drawn) and len(set(drawn)) == 4
    with pytest.raises(Exception, match="different length"):
        value(v.add("a", [1.0]))
    both = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k int, a array<double>")
    assert {r["k"]: r["a"] for r in v.sum_vectors(both, "a", "k").collect()} == {1: [4, 6], 2: [5, 6]}
    assert v.sum_vectors(both, "a").first()["a"] == [9, 12]


def test_udfs(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "k int, s string")
    rows = udfs.table_function(df, lambda s: ((w, len(w)) for w in s.split()), "s", "w string, n int", ["k"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    import pyarrow.compute as pc

    upper = udfs.scalar_arrow(lambda s: pc.utf8_upper(s), "string")
    assert sorted(r[0] for r in df.select(upper("s")).collect()) == ["A B", "C"]
    other = spark.createDataFrame([(1, 5.0)], "k int, x double")
    both = udfs.co_map_groups(
        df, other, "k", lambda a, b: pd.DataFrame({"n": [len(a) * 10 + len(b)]}), "n long"
    )
    assert sorted(r[0] for r in both.collect()) == [10, 11]
