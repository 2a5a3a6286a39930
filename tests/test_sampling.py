"""Samples: exact sizes, bounds, disjoint parts, repeatable seeds."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.operators import sampling


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(0, 5000, 1, 6)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_bernoulli_and_poisson(numbers):
    a = ids(sampling.sample(numbers, 0.2, 3))
    assert a == ids(sampling.sample(numbers, 0.2, 3))
    assert a != ids(sampling.sample(numbers, 0.2, 4))
    assert len(set(a)) == len(a) and abs(len(a) - 1000) < 6 * math.sqrt(800)
    copies = ids(sampling.sample(numbers, 1.5, 3, with_replacement=True))
    assert abs(len(copies) - 7500) < 6 * math.sqrt(7500)
    assert max(Counter(copies).values()) > 1
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            sampling.sample(numbers, bad, 1)


def test_split_parts_are_the_whole(numbers):
    parts = [ids(p) for p in sampling.random_split(numbers, [1, 2, 3], 5)]
    assert sorted(sum(parts, [])) == list(range(5000))
    assert all(abs(len(p) - 5000 * w / 6) < 200 for p, w in zip(parts, (1, 2, 3)))
    inside, outside = sampling.cell_sample(numbers, 0.1, 0.4, 5)
    assert sorted(ids(inside) + ids(outside)) == list(range(5000))
    with pytest.raises(ValueError):
        sampling.random_split(numbers, [1, -1], 5)


@pytest.mark.parametrize("n", [0, 1, 7, 100, 3000, 5000, 9000])
def test_take_sample(numbers, n):
    got = ids(sampling.take_sample(numbers, n, 11))
    assert len(got) == min(n, 5000) == len(set(got))


def test_take_sample_with_replacement(numbers):
    for n in (1, 100, 8000):
        got = ids(sampling.take_sample(numbers, n, 11, with_replacement=True))
        assert len(got) == n and set(got) <= set(range(5000))
    assert len(set(got)) < n


@pytest.mark.parametrize("total", [50, 10_000])
@pytest.mark.parametrize("n", [1, 10, 49])
def test_oversampling_rate_is_enough(total, n):
    """Exact tail: the chance of too few rows stays below 1e-4."""
    rate = sampling.oversampling_fraction(n, total, False)
    short = sum(
        math.comb(total, k) * rate**k * (1 - rate) ** (total - k) for k in range(n)
    )
    assert short <= 1e-4
    mean = sampling.oversampling_fraction(n, total, True) * total
    assert sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(n)) <= 1e-4


@pytest.fixture(scope="module")
def strata(spark):
    rows = [("a", i) for i in range(2000)] + [("b", i) for i in range(100)] + [(None, i) for i in range(7)]
    return spark.createDataFrame(rows, "s string, id int").repartition(5)


RATES = {"a": 0.3, "b": 0.11, None: 0.5}


def test_sample_by_key(strata):
    for replace in (False, True):
        got = Counter(r["s"] for r in sampling.sample_by_key(strata, "s", RATES, 2, replace).collect())
        assert abs(got["a"] - 600) < 6 * math.sqrt(600)
        assert abs(got["b"] - 11) < 6 * math.sqrt(11)
    with pytest.raises(Exception, match="no rate for key"):
        sampling.sample_by_key(strata, "s", {"a": 0.3, "b": 0.1}, 2).collect()
    with pytest.raises(ValueError):
        sampling.sample_by_key(strata, "s", {"a": -1.0}, 2)


@pytest.mark.parametrize("replace", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_sample_by_key_exact(strata, seed, replace):
    rows = sampling.sample_by_key_exact(strata, "s", RATES, seed, replace).collect()
    got = Counter(r["s"] for r in rows)
    assert got == {"a": 600, "b": 11, None: 4}
    if not replace:
        assert len({(r["s"], r["id"]) for r in rows}) == len(rows)


def test_exact_sample_takes_all_or_nothing(strata):
    everything = sampling.sample_by_key_exact(strata, "s", {"a": 1.0, "b": 0.0, None: 1.0}, 3)
    assert Counter(r["s"] for r in everything.collect()) == {"a": 2000, None: 7}


def test_exact_sample_is_fair(spark):
    """Every row of a hot key is about as likely as any other."""
    df = spark.createDataFrame([("h", i) for i in range(40)], "s string, id int").repartition(3)
    hits = Counter()
    for seed in range(12):
        hits.update(r["id"] for r in sampling.sample_by_key_exact(df, "s", {"h": 0.5}, seed).collect())
    assert sum(hits.values()) == 240
    assert max(hits.values()) <= 12 and len(hits) == 40


def test_reservoir(numbers):
    rows = sampling.reservoir_per_partition(numbers, 10, 1).collect()
    by = Counter(r["partition"] for r in rows)
    assert set(by.values()) == {10} and len(by) == 6
    assert sum({r["partition"]: r["partition_rows"] for r in rows}.values()) == 5000
    again = sampling.reservoir_per_partition(numbers, 10, 1).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in again)
    small = sampling.reservoir_per_partition(numbers.filter(F.col("id") < 3), 10, 1)
    assert sorted(r["id"] for r in small.collect()) == [0, 1, 2]


def test_rows_survive_unchanged(spark):
    """Large integers beside nulls, dates and lists come back exactly as they were."""
    rows = [(2**60 + i if i % 2 else None, [i, None], "x" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "big long, xs array<int>, s string").coalesce(2)
    whole = {repr(r) for r in rows}
    sample = sampling.sample_by_key(df, "s", {"x": 3.0, None: 2.0}, 1, with_replacement=True)
    assert {repr((r["big"], r["xs"], r["s"])) for r in sample.collect()} <= whole
    kept = sampling.reservoir_per_partition(df, 20, 1).collect()
    assert {repr((r["big"], r["xs"], r["s"])) for r in kept} <= whole and len(kept) == 40


def test_rates_as_a_table(spark, strata):
    table = spark.createDataFrame([(k, v) for k, v in RATES.items()], "k string, r double")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(sampling.sample_by_key(strata, "s", table, 2)) == rows(sampling.sample_by_key(strata, "s", RATES, 2))
    with pytest.raises(Exception, match="no rate for key"):
        sampling.sample_by_key(strata, "s", table.filter("k = 'a'"), 2).collect()
