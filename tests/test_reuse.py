"""Plan matching, the result store, eviction and staleness."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keyloom.reuse import catalog, plans, store

SCHEMA = plans.SCHEMA


def plan(job, *steps):
    rows = []
    for i, step in enumerate(steps):
        op, fn, *inputs = step
        rows.append((job, i, op, fn, list(inputs), [1] * len(inputs)))
    return rows


WORDS = [("scan", "", "/d"), ("flatMap", "split"), ("map", "one"), ("reduceByKey", "sum")]
PLANS = [
    plan("a", *WORDS),
    plan("b", ("SCAN", "", "/d"), ("FLATMAP", "Split"), ("map", "two"), ("reduceByKey", "sum")),
    plan("c", ("scan", "", "/other"), *WORDS[1:]),
    plan("d", ("scan", "", "/x"), ("filter", "f"), *WORDS, ("join", "")),
    plan("e", ("map", "one"), ("reduceByKey", "sum")),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([r for p in PLANS for r in p], SCHEMA)


def walked_match(a, b):
    """Walk forward from every pair of scans and keep the longest run."""

    def same(x, y):
        return x[2].lower() == y[2].lower() and x[3].lower() == y[3].lower() and x[4] == y[4]

    best = (0, 0, 0, 0, 0)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x[2].lower() == y[2].lower() == "scan":
                n = 0
                while i + n < len(a) and j + n < len(b) and same(a[i + n], b[j + n]):
                    n += 1
                if n > best[0]:
                    best = (n, i, i + n - 1, j, j + n - 1)
    return best


def test_match_plans(spark, nodes):
    jobs = {p[0][0]: p for p in PLANS}
    pairs = [(x, y) for x in jobs for y in jobs]
    got = plans.match_plans(nodes, spark.createDataFrame(pairs, "job_a string, job_b string"))
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == {
        (x, y): walked_match(jobs[x], jobs[y]) for x, y in pairs
    }


def test_shares_and_assignments(spark, nodes):
    pairs = spark.createDataFrame([("a", "b"), ("d", "a"), ("a", "c")], "job_a string, job_b string")
    shares = {(r[0], r[1]): r[2] for r in plans.reuse_matrix(nodes, pairs).collect()}
    assert shares == {("a", "b"): 0.5, ("d", "a"): 4 / 7, ("a", "c"): 0.0}
    order = spark.createDataFrame([(j, i) for i, j in enumerate("ecbad")], "job_id string, seq int")
    got = {r["job_id"]: (r["source_job"], r["share"]) for r in plans.plan_reuse(nodes, order).collect()}
    assert got == {"a": ("b", 0.5), "d": ("a", 4 / 7)}


NOW = datetime(2024, 5, 10)


def entries(spark, *changes):
    base = dict(id=0, path="", size_gib=2.0, ms=5, reuse=1, n_nodes=3, n_scans=1, inserted=NOW)
    rows = [{**base, "id": i, "path": f"p{i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "id int, path string, size_gib double, ms long, reuse int, n_nodes int, n_scans int, inserted timestamp")


def evicted(df, capacity, needed):
    return {r["id"]: r["reason"] for r in catalog.evict_candidates(df, capacity, needed, NOW).collect()}


def test_eviction(spark):
    week = {"inserted": NOW - timedelta(days=8)}
    df = entries(
        spark, {"reuse": 0}, {"ms": 1}, {"size_gib": 1.0}, {"n_nodes": 2}, {"n_scans": 0}, {"reuse": 9, **week}
    )
    # 11 GiB used
    assert evicted(df, 20, 9) == {}
    assert evicted(df, 12, 3) == {5: "age"}
    assert evicted(df, 11, 3) == {5: "age", 0: "rank"}
    assert evicted(df, 11, 5) == {5: "age", 0: "rank", 1: "rank"}
    assert evicted(df, 11, 6.5) == {5: "age", 0: "rank", 1: "rank", 2: "rank"}
    assert evicted(df, 11, 7.5) == {5: "age", 0: "rank", 1: "rank", 2: "rank", 3: "rank"}
    assert evicted(df, 11, 11) == {5: "age", **{i: "rank" for i in range(5)}}
    with pytest.raises(ValueError, match="larger"):
        evicted(df, 11, 12)


def test_stale(spark):
    stored = spark.createDataFrame([("x", "/a", 1), ("x", "/b", 2), ("y", "/a", 1), ("z", "/gone", 1)], "id string, path string, mtime long")
    current = spark.createDataFrame([("/a", 1), ("/b", 3)], "path string, mtime long")
    assert sorted(r["id"] for r in catalog.stale_entries(stored, current).collect()) == ["x", "z"]


def test_function_identity():
    def make(n):
        return lambda df: df.limit(n)

    assert store.function_identity(make(1)) == store.function_identity(make(1))
    assert store.function_identity(make(1)) != store.function_identity(make(2))
    assert store.function_identity(len) != store.function_identity(len)
    assert store.function_identity(make(object())) != store.function_identity(make(object()))


LIMIT = 1


def test_function_identity_sees_code_and_globals():
    global LIMIT
    pair = [lambda df: df.limit(1), lambda df: df.limit(2)]  # noqa: E731 - on one line
    assert store.function_identity(pair[0]) != store.function_identity(pair[1])

    def limited(df):
        return df.limit(LIMIT)

    before = store.function_identity(limited)
    assert store.function_identity(limited) == before
    LIMIT = 2
    try:
        assert store.function_identity(limited) != before
    finally:
        LIMIT = 1

    def nested(n):
        def inner(df):
            return limited(df).select(F.lit(n), F.col("id"))

        return lambda df: inner(df)

    assert store.function_identity(nested(1)) == store.function_identity(nested(1))
    assert store.function_identity(nested(1)) != store.function_identity(nested(True))


def test_store_tells_steps_apart_to_the_letter(spark, tmp_path):
    path = str(tmp_path / "flags")
    spark.createDataFrame([("R",)] * 6 + [("r",)] * 4, "flag string").write.parquet(path)
    results = store.ResultStore(spark, str(tmp_path / "store"))
    upper = store.Pipeline(spark, "a", [path]).then("filter", lambda df: df.filter("flag = 'R'"), "flag = 'R'")
    lower = store.Pipeline(spark, "b", [path]).then("filter", lambda df: df.filter("flag = 'r'"), "flag = 'r'")
    results.store(upper)
    assert results.find(lower) is None and results.run(lower).count() == 4
    assert results.find(upper) is not None and results.run(upper).count() == 6


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(0, 100, 1, 2).write.parquet(path)
    return path


def pipeline(spark, path):
    return (
        store.Pipeline(spark, "job", [path])
        .then("filter", lambda df: df.filter("id % 2 = 0"), "even")
        .then("map", lambda df: df.select((F.col("id") * 3).alias("x")), "times three")
        .then("reduce", lambda df: df.agg(F.sum("x").alias("s")), "sum")
    )


def test_store_and_resume(spark, numbers, tmp_path):
    job = pipeline(spark, numbers)
    results = store.ResultStore(spark, str(tmp_path / "store"))
    assert results.find(job) is None and results.run(job).first()["s"] == 7350
    results.store(job, steps=1)
    results.store(job, steps=2)
    found = results.find(job)
    assert found[2] == 2
    assert results.run(job).first()["s"] == 7350
    assert found[1] in str(results.run(job).inputFiles())
    hits = {r["steps"]: r["reuse"] for r in results.catalog().collect()}
    assert hits == {1: 0, 2: 2}
    other = store.Pipeline(spark, "other", [numbers]).then("filter", lambda df: df.filter("id > 90"), "big")
    assert results.find(other) is None
    nodes = [tuple(r)[1:4] for r in job.nodes().orderBy("pos").collect()]
    assert nodes == [(0, "scan", ""), (1, "filter", "even"), (2, "map", "times three"), (3, "reduce", "sum")]


def test_changed_input_is_a_miss(spark, numbers, tmp_path):
    job = pipeline(spark, numbers)
    results = store.ResultStore(spark, str(tmp_path / "store"))
    results.store(job, steps=2)
    assert results.find(job) is not None
    spark.range(1000, 1002).coalesce(1).write.mode("append").parquet(numbers)
    assert results.find(job) is None
    assert results.run(job).first()["s"] == 7350 + 3000
    fresh = pipeline(spark, numbers)
    results.store(fresh, steps=2)
    assert results.find(fresh) is not None
    part = next(f for f in os.listdir(numbers) if f.startswith("part"))
    os.utime(os.path.join(numbers, part), (1, 1))
    assert results.find(fresh) is None


def test_store_makes_room(spark, numbers, tmp_path):
    job = pipeline(spark, numbers)
    results = store.ResultStore(spark, str(tmp_path / "store"))
    results.store(job, steps=1)
    size = results.catalog().first()["size_gib"]
    small = store.ResultStore(spark, str(tmp_path / "store"), capacity_gib=size * 1.5)
    small.store(job, steps=2)
    assert [r["steps"] for r in small.catalog().collect()] == [2]
    assert len(os.listdir(tmp_path / "store" / "results")) == 1
    tiny = store.ResultStore(spark, str(tmp_path / "tiny"), capacity_gib=size / 1000)
    with pytest.raises(ValueError, match="larger"):
        tiny.store(job, steps=1)
    assert os.listdir(tmp_path / "tiny" / "results") == []
