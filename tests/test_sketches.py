"""Stored sketches, and quantiles of many groups, against exact answers."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import approx, distributions


@pytest.fixture(scope="module")
def values(spark):
    key = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 50)
    return spark.range(60000).select(key.alias("g"), F.pmod(F.xxhash64("id"), F.lit(30011)).cast("double").alias("x"), "id")


def test_sketches_of_parts_unite_to_the_whole(values):
    part = values.withColumn("part", F.col("id") % 3)
    parts = approx.distinct_sketches(part, ["g", "part"], "x")
    whole = approx.distinct_sketches(values, "g", "x")
    united = {r["g"]: r["distinct"] for r in approx.distinct_of(approx.unite_sketches(parts, "g")).collect()}
    again = approx.unite_sketches(whole.unionByName(parts.drop("part")), "g")
    assert united == {r["g"]: r["distinct"] for r in approx.distinct_of(again).collect()}
    exact = {r["g"]: r["n"] for r in values.groupBy("g").agg(F.count_distinct("x").alias("n")).collect()}
    assert all(abs(united[g] - n) <= 0.07 * n + 1 for g, n in exact.items()) and len(exact) == len(united)
    total = approx.distinct_of(approx.unite_sketches(parts, [])).first()["distinct"]
    assert abs(total - values.select("x").distinct().count()) < 0.07 * total
    with pytest.raises(ValueError):
        approx.distinct_sketches(values, "g", "x", lg_k=30)


def ranks_off(rows, points):
    worst = 0.0
    for g, p, value in points:
        own = rows[g]
        below, upto = sum(x < value for x in own), sum(x <= value for x in own)
        worst = max(worst, (below - p * len(own)) / len(own), (p * len(own) - upto) / len(own))
    return worst


def grouped(values):
    rows = {}
    for g, x in values.select("g", "x").collect():
        rows.setdefault(g, []).append(x)
    return rows


def test_sketched_quantiles(spark, values):
    none = F.when(F.col("g") == 0, F.col("x"))
    got = distributions.sketched_quantiles(values, {"x": F.col("x"), "some": none}, by="g", accuracy=500).collect()
    rows = grouped(values)
    points = [(r["g"], r["probability"], r["value"]) for r in got if r["metric"] == "x"]
    assert len(points) == 5 * len(rows) and ranks_off(rows, points) <= 1 / 500 + 1 / min(map(len, rows.values()))
    assert {r["g"] for r in got if r["metric"] == "some"} == {0}
    assert distributions.sketched_quantiles(values.limit(0), {"x": F.col("x")}, by="g").count() == 0
    with pytest.raises(ValueError):
        distributions.sketched_quantiles(values, {"x": F.col("x")}, [1.5])


def test_quantile_sketches_unite(values):
    parts = distributions.quantile_sketches(values.withColumn("part", F.col("id") % 4), "x", ["g", "part"])
    got = distributions.quantiles_of(distributions.unite_quantile_sketches(parts, "g"), [0.1, 0.5, 0.9]).collect()
    rows = grouped(values)
    assert len(got) == 3 * len(rows) and ranks_off(rows, [tuple(r) for r in got]) <= 0.05
