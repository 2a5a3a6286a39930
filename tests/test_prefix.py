"""Positions, running totals and what is built on them, against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keyloom.operators import distributions, layout, positions
from keyloom.plans.prefix import running, with_position


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_position(spark, ranges):
    values = random.Random(1).sample(range(1000), 200)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    placed, n = with_position(df, [F.col("v").desc()], "i", ranges)
    assert n == 200
    assert {r["v"]: r["i"] for r in placed.collect()} == {
        v: i for i, v in enumerate(sorted(values, reverse=True))
    }


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_running(spark, ranges):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(1, 9)) for i in range(150)]
    df = spark.createDataFrame(data, "g string, i int, w int").repartition(4)
    got = running(df, ["g"], ["i"], {"s": ("w", "sum"), "m": ("w", "min")}, ranges)
    seen = defaultdict(list)
    want = {}
    for g, i, w in sorted(data, key=lambda r: r[1]):
        want[i] = (sum(seen[g]), min(seen[g], default=None))
        seen[g].append(w)
    assert {r["i"]: (r["s"], r["m"]) for r in got.collect()} == want
    whole = running(df, [], ["i"], {"s": ("w", "sum")}, ranges)
    total, flat = 0, {}
    for _, i, w in data:
        flat[i] = total
        total += w
    assert {r["i"]: r["s"] for r in whole.collect()} == flat


def test_zip_with_index_refuses_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    with pytest.raises(ValueError, match="tie"):
        positions.zip_with_index(df, "v")
    loose = positions.zip_with_index(df, "v", on_tie="any")
    assert sorted(r["index"] for r in loose.collect()) == [0, 1, 2]


def test_zip_length_check(spark):
    a = spark.range(5).select(F.col("id").alias("a"))
    b = spark.range(4).select(F.col("id").alias("b"))
    with pytest.raises(ValueError, match="5 rows with 4"):
        positions.zip_tables(a, b, "a", "b")
    c = spark.range(10, 15).select(F.col("id").alias("c"))
    assert sorted(tuple(r) for r in positions.zip_tables(a, c, "a", "c").collect()) == [
        (i, i + 10) for i in range(5)
    ]


def test_unique_ids(spark):
    df = spark.range(0, 100, 1, 7)
    ids = [r["u"] for r in positions.zip_with_unique_id(df, "u").collect()]
    assert len(set(ids)) == 100
    parts = [r[0] for r in df.select(F.spark_partition_id()).collect()]
    assert {i % 7 for i in ids} == set(parts)
    with pytest.raises(Exception, match="more than 3 partitions"):
        positions.zip_with_unique_id(df, "u", 3).collect()


def test_zip_partitions_of_different_length(spark):
    import pandas as pd

    a = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "p int, x string")
    b = spark.createDataFrame([(0, 1)], "p int, y int")
    c = spark.createDataFrame([(2, 2.5)], "p int, z double")

    def sizes(x, y, z):
        yield pd.DataFrame({"s": [f"{len(x)}{len(y)}{len(z)}"]})

    got = positions.zip_partitions([a, b, c], sizes, "s string", 3, F.col("p"))
    assert sorted(r["s"] for r in got.collect()) == ["001", "100", "210"]


@pytest.mark.parametrize("skewed", [False, True])
def test_closest_quantiles(spark, skewed):
    rng = random.Random(3)
    data = [
        (rng.choice("aab"), 5.0 if skewed and rng.random() < 0.6 else float(rng.randint(0, 50)))
        for _ in range(300)
    ] + [("c", 1.5), ("c", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    want = {}
    for g in "abc":
        values = sorted(v for h, v in data if h == g and v is not None)
        for p in points:
            want[(g, p)] = values[min(int(p * len(values)), len(values) - 1)]
    got = distributions.closest_quantiles(df, "v", points, "g")
    assert {(r["g"], r["probability"]): r["value"] for r in got.collect()} == want
    whole = sorted(v for _, v in data if v is not None)
    got = distributions.closest_quantiles(df, "v", points)
    assert {r["probability"]: r["value"] for r in got.collect()} == {
        p: whole[min(int(p * len(whole)), len(whole) - 1)] for p in points
    }


def greedy_bounds(keys, n):
    """Walk the sorted keys and take one when the running count reaches the next step."""
    bounds, seen, previous = [], 0, None
    for key in sorted(keys):
        seen += 1
        if len(bounds) < n - 1 and seen * n >= (len(bounds) + 1) * len(keys):
            if previous is None or key > previous:
                bounds.append(key)
                previous = key
    return bounds


@pytest.mark.parametrize("seed", range(6))
def test_range_bounds(spark, seed):
    rng = random.Random(seed)
    heavy = rng.randint(0, 9)
    keys = [heavy if rng.random() < 0.5 * (seed % 3) else rng.randint(0, 40) for _ in range(120)]
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(3)
    n = rng.choice([2, 5, 9])
    got = layout.range_bounds(df, "k", n).orderBy("bound").collect()
    assert [r["key"] for r in got] == greedy_bounds(keys, n)
    assert [r["bound"] for r in got] == list(range(1, len(got) + 1))


def test_sampled_range_bounds_balance(spark):
    df = spark.range(0, 20_000, 1, 8)
    bounds = [r["key"] for r in layout.range_bounds(df, "id", 5, fraction=0.05, seed=3).orderBy("bound").collect()]
    assert len(bounds) == 4
    edges = [0, *bounds, 20_000]
    sizes = [b - a for a, b in zip(edges[:-1], edges[1:])]
    assert max(sizes) < 3 * min(sizes)


HISTOGRAM = [-0.01, 0.0, 1, 2, 3, 5, 6, 11.01, 12.0, 199.0, 200.0, 200.1]
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("values", "edges", "counts"),
    [
        (HISTOGRAM, [0, 5, 11, 12, 200], [4, 2, 1, 3]),
        ([*HISTOGRAM, NAN], [0, 5, 11, 12, 200], [4, 2, 1, 3]),
        ([*HISTOGRAM, NAN], [0, 5, 11, 12, 200, NAN], [4, 2, 1, 2, 3]),
        ([*HISTOGRAM, INF, -INF, NAN], [0, 5, 11, 12, 200, NAN], [4, 2, 1, 2, 4]),
        ([10.01, -0.01], [0, 10], [0]),
        ([1, 2, 3, 5, 6, NAN], [0, 5, 10], [3, 2]),
        ([], [0, 10], [0]),
    ],
)
def test_histogram_edges(spark, values, edges, counts):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = distributions.histogram_edges(df, "v", edges).orderBy("bucket").collect()
    assert [r["count"] for r in got] == counts


def test_histogram_even(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6)], "v double")
    got = distributions.histogram(df, "v", 3).orderBy("bucket").collect()
    assert [r["count"] for r in got] == [2, 2, 2]
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r["count"] for r in distributions.histogram(same, "v", 5).collect()] == [4]
    for bad in ([], [1.0, NAN], [1.0, INF]):
        with pytest.raises(ValueError):
            distributions.histogram(spark.createDataFrame([(v,) for v in bad], "v double"), "v", 2)
    with pytest.raises(ValueError):
        distributions.histogram_edges(df, "v", [1])
    with pytest.raises(ValueError):
        distributions.histogram_edges(df, "v", [3, 1, 2])


def test_distribution_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    row = distributions.distribution_summary(df, "v").first()
    assert (row["count"], row["mean"], row["q0"], row["q50"], row["q100"]) == (100, 50.5, 1, 51, 100)
    assert Counter([row["max"], row["min"]]) == Counter([100.0, 1.0])


def test_index_in_present_order(spark):
    df = spark.range(0, 50, 1, 4).orderBy(F.col("id").desc())
    got = {r["id"]: r["i"] for r in positions.zip_with_index(df, name="i").collect()}
    assert got == {v: 49 - v for v in range(50)}


def test_zip_partitions_checks_its_partitions(spark):
    import pandas as pd

    from keyloom.operators import positions

    def pair(a, b):
        yield pd.DataFrame({"a": [len(a)], "b": [len(b)]})

    left, right = spark.range(0, 80, 1, 8), spark.range(0, 16, 1, 8)
    got = positions.zip_partitions([left, right], pair, "a long, b long", 8).collect()
    assert [tuple(r) for r in got] == [(10, 2)] * 8
    for n, other in ((4, right), (8, spark.range(0, 16, 1, 4))):
        with pytest.raises(ValueError, match="cannot zip"):
            positions.zip_partitions([left, other], pair, "a long, b long", n)
    with pytest.raises(Exception, match="outside 0 to 3"):
        positions.zip_partitions([left, right], pair, "a long, b long", 4, F.col("id") % 5).collect()


def test_vector_sums(spark):
    from keyloom.functions import vectors

    rows = [(1, [1.0, 2.0]), (1, [3.0, None]), (None, [5.0]), (2, None), (1, [1.0, 1.0, 7.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got = {r["k"]: r["v"] for r in vectors.sum_vectors(df, "v", "k").collect()}
    assert got == {1: [5.0, 3.0, 7.0], None: [5.0]}
    assert vectors.sum_vectors(df, "v").first()["v"] == [10.0, 3.0, 7.0]
