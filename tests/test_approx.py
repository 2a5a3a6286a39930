"""Sketch bounds, quantile tables, estimates and partial results."""

import math
import time

import pytest
from pyspark.sql import functions as F

from keyloom.functions.quantiles import confidence_factor, normal_quantile, student_t_quantile
from keyloom.operators import approx


@pytest.mark.parametrize(
    ("df", "p", "t"),
    [  # printed tables
        (1, 0.975, 12.7062), (2, 0.975, 4.3027), (5, 0.95, 2.0150), (10, 0.975, 2.2281),
        (30, 0.995, 2.7500), (99, 0.975, 1.9842),
    ],
)
def test_student_t(df, p, t):
    assert abs(student_t_quantile(p, df) - t) < 5e-5


def test_factors():
    assert abs(normal_quantile(0.975) - 1.959964) < 1e-6
    assert confidence_factor(0.95, 101) == normal_quantile(0.975)
    assert confidence_factor(0.95, 100) == student_t_quantile(0.975, 99)
    assert math.isnan(confidence_factor(0.95, 1))


@pytest.mark.parametrize(
    ("options", "bound"), [({"p": 8}, 0.2), ({"p": 12}, 0.1), ({"relative_sd": 0.02}, 0.1), ({"relative_sd": 0.5}, 0.22)]
)
def test_distinct(spark, options, bound):
    df = spark.range(1, 5001).select((F.col("id") % 1000).alias("v"))
    got = approx.count_approx_distinct(df, "v", **options).first()["distinct"]
    assert abs(got - 1000) / 1000 < bound


def test_distinct_by_key(spark):
    rows = [(k, v) for k in range(1, 101) for v in range(k)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = approx.count_approx_distinct_by_key(df, "k", "v", p=18)
    assert all(abs(r["distinct"] - r["k"]) <= 0.01 * r["k"] for r in got.collect())


def test_distinct_arguments():
    for bad in ({"relative_sd": 0.00001}, {"p": 3}, {"p": 12, "sp": 33}, {"p": 12, "sp": 11}, {"p": 22}, {"p": 12, "sp": 20}, {"relative_sd": 0.0002}):
        with pytest.raises(ValueError):
            approx.approx_distinct_column("v", **bad)


def test_progress_small_groups(spark):
    """Up to 100 values the interval is that of Student's t."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 5.0), ("b", 3, 2.0)], "g string, p int, x double")
    rows = approx.estimate_progress(df, F.col("p"), 4, "x", "g", "mean").collect()
    got = {(r["g"], r["merged"]): r["estimate"] for r in rows}
    first = got[("a", 1)]
    half = student_t_quantile(0.975, 1) * math.sqrt(2.0 / 2)
    assert abs(first["mean"] - 2) < 1e-12 and abs(first["high"] - (2 + half)) < 1e-9
    assert got[("a", 4)]["confidence"] == 1.0 and got[("a", 4)]["mean"] == 3.0
    assert ("b", 3) not in got and got[("b", 4)]["low"] == 2.0
    only = approx.estimate_progress(df, F.col("p"), 4, after=[2]).collect()
    p = 0.5
    assert [r["merged"] for r in only] == [2]
    assert abs(only[0]["estimate"]["mean"] - (3 + 1 - p) / p) < 1e-12
    with pytest.raises(ValueError):
        approx.estimate_progress(df, F.col("p"), 4, what="sum")


def test_progress_is_stable_for_large_means(spark):
    df = spark.range(0, 1000).select((F.col("id") % 4).alias("p"), (F.col("id") % 10 + 1e9).alias("x"))
    for what in ("mean", "sum"):
        plain = approx.estimate_progress(df.withColumn("x", F.col("x") - 1e9), F.col("p"), 4, "x", what=what).collect()
        moved = approx.estimate_progress(df, F.col("p"), 4, "x", what=what).collect()
        assert len(moved) == 4 and not any(math.isnan(r["estimate"]["low"]) for r in moved)
        if what == "mean":
            for a, b in zip(sorted(plain), sorted(moved)):
                assert abs((a["estimate"]["high"] - a["estimate"]["low"]) - (b["estimate"]["high"] - b["estimate"]["low"])) < 1e-5


def test_grouped_results_become_exact(spark):
    df = spark.range(0, 9000, 1, 30).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    df = df.withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    counts = approx.count_by_key_approx(df, "k", 60).final(120)
    assert {None if k != k else k: v.mean for k, v in counts.items()} == {None: 3000, 1: 3000, 2: 3000}
    means = approx.grouped_mean_approx(df.filter("k > 0"), "k", "x", 60).final(120)
    assert abs(means[1].mean - 4499.5) < 1e-6 and means[1].confidence == 1.0
    sums = approx.grouped_sum_approx(df.filter("k > 0"), "k", "x", 60).final(120)
    assert abs(sums[2].mean - 3000 * 4500.5) < 1e-3
    values = approx.count_by_value_approx(df.select("k").filter("k > 0"), 60).final(120)
    assert {k: v.mean for k, v in values.items()} == {1: 3000, 2: 3000}


def test_grouped_deadline(spark):
    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    df = spark.range(0, 4800, 1, 48).mapInPandas(slow, "id long").withColumn("k", F.col("id") % 2)
    result = approx.count_by_key_approx(df, "k", timeout=1.0)
    first = result.initial(30)
    assert all(v.confidence < 1.0 and v.low <= v.mean <= v.high for v in first.values())
    assert {k: v.mean for k, v in result.final(120).items()} == {0: 2400, 1: 2400}


def test_partial_results_become_exact(spark):
    df = spark.range(0, 10_000, 1, 40).select(F.col("id").cast("double").alias("x"))
    assert approx.count_approx(df, 60).final(120) == approx.Bounded(10_000, 1.0, 10_000, 10_000)
    total = approx.sum_approx(df, "x", 60).final(120)
    assert abs(total.mean - 49_995_000) < 1e-3 and total.confidence == 1.0
    assert abs(approx.mean_approx(df, "x", 60).final(120).mean - 4999.5) < 1e-9


def test_deadline_gives_an_estimate_first(spark):
    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    df = spark.range(0, 4800, 1, 48).mapInPandas(slow, "id long")
    result = approx.count_approx(df, timeout=1.0)
    first = result.initial(30)
    seen = []
    result.on_complete(seen.append)
    doubled = result.map(lambda b: b.mean * 2)
    last = result.final(120)
    assert last == approx.Bounded(4800, 1.0, 4800, 4800)
    assert first.confidence < 1.0 and first.low <= first.mean <= first.high
    assert doubled.final(30) == 9600
    time.sleep(0.1)
    assert seen == [last] and result.is_final


def test_failure_reaches_the_caller(spark):
    def broken(batches):
        raise RuntimeError("no luck")
        yield

    result = approx.count_approx(spark.range(10).mapInPandas(broken, "id long"), 60)
    errors = []
    result.on_fail(errors.append)
    with pytest.raises(Exception, match="no luck"):
        result.final(120)
    time.sleep(0.1)
    assert len(errors) == 1
