"""Exact quantiles of many columns, gathered by group or through the long way."""

from pyspark.sql import functions as F

from keyloom.operators.distributions import closest_quantiles, closest_quantiles_of_columns


def test_small_and_large_groups_agree_with_the_long_way(spark, rows):
    df = spark.createDataFrame(
        [("a" if k % 5 else None, k % 2, float(k * 7 % 11) if k % 3 else None, -0.0 if k % 2 else 0.0) for k in range(60)]
        + [("b", None, float("nan"), None), ("b", None, 1.0, None)],
        "g string, h int, x double, y double",
    )
    points = (0.0, 0.05, 0.5, 0.95, 1.0)
    columns = {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None)}
    long = df.select("g", "h", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in "xy"])).alias("e")).select("g", "h", "e.*")
    want = rows(closest_quantiles(long, "value", points, ["g", "h", "metric"]).select("g", "h", "metric", "probability", "value"))
    for limit in (100_000, 10, 0):
        got = closest_quantiles_of_columns(df, columns, points, ["g", "h"], limit)
        assert list(map(repr, rows(got))) == list(map(repr, want))


def test_gathered_groups_are_shuffled_once_a_row(spark):
    df = spark.range(1000).selectExpr("id % 100 AS g", "id AS x", "id * 2 AS y", "id * 3 AS z")
    plan = closest_quantiles_of_columns(df, {c: F.col(c) for c in "xyz"}, (0.5,), "g")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1
    assert plan.count() == 300
