"""Hot keys: every split gives the same result as no split."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.jobs.pagerank import pagerank
from keyloom.operators import aggregates, joins, sets, udfs
from keyloom.plans import skew


def table(spark, seed, n, name, partitions=5):
    """A third of all rows has key 1; some keys are null."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = 1 if rng.random() < 0.33 else rng.choice([None, 2, 3, 4, 5, 6 + seed])
        data.append((key, f"{name}{i}" if rng.random() < 0.9 else None))
    df = spark.createDataFrame(data, f"k long, {name} string").repartition(partitions)
    return data, df


def expected(left, right, how, null_safe):
    def same(a, b):
        return a == b if null_safe else a is not None and a == b

    out = Counter()
    for k, v in left:
        found = [w for j, w in right if same(k, j)]
        for w in found:
            out[(k, v, w)] += 1
        if not found and how in ("left", "full"):
            out[(k, v, None)] += 1
    for j, w in right:
        if how in ("right", "full") and not any(same(k, j) for k, _ in left):
            out[(j, None, w)] += 1
    return out


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("limit", [4, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join(spark, how, limit, null_safe):
    left_data, left = table(spark, 1, 60, "v")
    right_data, right = table(spark, 2, 40, "w")
    got = joins.join(left, right, "k", how, null_safe, rows_per_task=limit)
    assert Counter(tuple(r) for r in got.collect()) == expected(left_data, right_data, how, null_safe)


def test_one_sided_hot_key(spark):
    """A hot key without any partner on the other side."""
    left = spark.createDataFrame([(9, f"a{i}") for i in range(20)], "k long, v string").repartition(6)
    right = spark.createDataFrame([(1, "x")], "k long, w string")
    full = joins.join(left, right, "k", "full", rows_per_task=3)
    assert full.count() == 21
    assert full.filter("w is null").count() == 20


@pytest.mark.parametrize("partitions", [1, 5])
def test_group_by_key_chunks(spark, partitions):
    data, df = table(spark, 3, 90, "v", partitions)
    chunks = aggregates.group_by_key_chunks(df, "k", rows_per_chunk=5)
    got = Counter()
    for row in chunks.collect():
        for value in row["values"]:
            got[(row["k"], value["v"])] += 1
    assert got == Counter(data)
    assert chunks.filter("k = 1").count() > 1
    whole = aggregates.group_by_key(df, "k")
    assert whole.count() == len({k for k, _ in data})
    assert Counter((r["k"], x["v"]) for r in whole.collect() for x in r["values"]) == Counter(data)


def test_cogroup_chunks(spark):
    left_data, left = table(spark, 4, 60, "v")
    right_data, right = table(spark, 5, 30, "w")
    for grouped in (
        joins.cogroup_chunks([left, right], "k", ["a", "b"], rows_per_chunk=4),
        joins.cogroup([left, right], "k", ["a", "b"]),
    ):
        got_left, got_right = Counter(), Counter()
        for row in grouped.collect():
            got_left.update((row["k"], x["v"]) for x in row["a"])
            got_right.update((row["k"], x["w"]) for x in row["b"])
        assert got_left == Counter(left_data)
        assert got_right == Counter(right_data)
    assert grouped.count() == len({k for k, _ in left_data + right_data})


def test_hot_key_in_one_partition(spark):
    """All rows of the key lie in one partition, and some are equal: parts come out even."""
    df = spark.createDataFrame([(1, f"v{i % 100}") for i in range(10_000)] + [(2, "x")], "k long, v string").coalesce(1)
    sizes = [len(r["values"]) for r in aggregates.group_by_key_chunks(df, "k", rows_per_chunk=1000).filter("k = 1").collect()]
    assert len(sizes) == 10 and sum(sizes) == 10_000 and max(sizes) < 1300
    right = spark.createDataFrame([(1, "a"), (3, "b")], "k long, w string")
    full = joins.join(df, right, "k", "full", rows_per_task=1000)
    assert full.count() == 10_002


def test_groups_are_whole_at_every_size(spark):
    data = [(1 if i % 3 else i % 7, float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "k long, v double").repartition(7)
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    median = {k: float(sorted(v)[len(v) // 2] + sorted(v)[(len(v) - 1) // 2]) / 2 for k, v in groups.items()}
    got = udfs.reduce_groups(df, "k", "v", lambda s: float(s.median()), "double")
    assert {r["k"]: r["v"] for r in got.collect()} == median
    mapped = udfs.map_groups(df, "k", lambda g: g.groupby("k", as_index=False)["v"].median(), "k long, v double")
    assert {r["k"]: r["v"] for r in mapped.collect()} == median
    total = lambda s: float(s.sum())
    nulls = df.union(spark.createDataFrame([(None, 1.0), (None, 2.0)], "k long, v double"))
    merged = udfs.merge_groups(nulls, "k", "v", total, total, "double")
    assert {r["k"]: r["v"] for r in merged.collect()} == {k: sum(v) for k, v in groups.items()} | {None: 3.0}


def test_broadcast_is_bounded_in_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 1000) AS wide")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(skew.broadcast_if_small(df))
    assert not hinted(skew.broadcast_if_small(df, max_bytes=5000))
    assert not hinted(skew.broadcast_if_small(df, max_rows=9))


def test_hot_copies_in_set_operations(spark):
    left = spark.createDataFrame([(1,)] * 30 + [(2,), (None,), (None,), (3,)], "v long")
    right = spark.createDataFrame([(1,)] * 5 + [(None,), (4,)], "v long")
    assert sorted(r[0] or 0 for r in sets.intersection(left, right).collect()) == [0, 1]
    assert sorted(r[0] for r in sets.subtract(left, right).collect()) == [2, 3]
    assert [r[0] for r in sets.subtract(right, left).collect()] == [4]


def plain_ranks(edges, rounds):
    links = {}
    for s, t in set(edges):
        links.setdefault(s, set()).add(t)
    ranks = {s: 1.0 for s in links}
    for _ in range(rounds):
        given = {}
        for s, targets in links.items():
            if s in ranks:
                for t in targets:
                    given[t] = given.get(t, 0.0) + ranks[s] / len(targets)
        ranks = {t: 0.15 + 0.85 * g for t, g in given.items()}
    return ranks


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_pagerank(spark, limit):
    edges = [(1, i) for i in range(2, 30)] + [(2, 1), (3, 1), (2, 3), (2, 3), (5, 2), (30, 5)]
    df = spark.createDataFrame(edges, "source long, target long").repartition(6)
    got = {r["node"]: r["rank"] for r in pagerank(df, 7, rows_per_task=limit).collect()}
    want = plain_ranks(edges, 7)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
