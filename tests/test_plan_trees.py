"""Digests of whole plans, and DataFrames that start from stored parts."""

import sys
import types

import pytest
from pyspark.sql import functions as F

from keyloom.reuse import plans, trees
from keyloom.reuse.identity import function_identity
from keyloom.reuse.store import ResultStore, frame_nodes

FOLDER = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def dear(spark, limit=100000, table="lineitem"):
    orders = read(spark, "orders").filter(F.col("o_totalprice") > limit)
    return orders.join(read(spark, table).filter("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey"))


def adding(k):
    @F.udf("long")
    def add(x):
        return x + k

    return add


def digest(df):
    return trees.tree(df).digest


def test_equal_plans(spark):
    assert digest(dear(spark)) == digest(dear(spark)) is not None
    orders = read(spark, "orders")
    assert digest(orders.alias("a").filter("o_custkey = 1")) == digest(orders.filter(F.col("o_custkey") == 1))
    assert digest(orders.select(adding(1)("o_custkey").alias("x"))) == digest(orders.select(adding(1)("o_custkey").alias("x")))
    assert digest(orders.groupBy("o_custkey").count()) == digest(read(spark, "orders").groupBy("o_custkey").count())


def test_unequal_plans(spark, tmp_path):
    orders = read(spark, "orders")
    copy = f"{tmp_path}/orders.parquet"
    orders.write.parquet(copy)
    different = [
        dear(spark), dear(spark, 100001), orders, spark.read.parquet(copy), orders.limit(1), orders.limit(2),
        orders.select(adding(1)("o_custkey").alias("x")), orders.select(adding(2)("o_custkey").alias("x")),
        orders.select(adding(1)("o_orderkey").alias("x")), orders.select(adding(1)("o_orderkey").alias("y")),
        orders.orderBy("o_custkey"), orders.orderBy(F.desc("o_custkey")), orders.orderBy(F.asc_nulls_last("o_custkey")),
        orders.sortWithinPartitions("o_custkey"), orders.select(F.hash(F.lit(1)).alias("x")), orders.select(F.hash(F.lit("1")).alias("x")),
        orders.select(F.lit(1).alias("x")), orders.select(F.lit(1).cast("long").alias("x")),
        orders.filter("o_custkey in (1, 2)"), orders.filter("o_custkey in (1, 3)"),
        orders.filter(F.col("o_custkey").isin(list(range(400)))), orders.filter(F.col("o_custkey").isin([*range(399), 400])),
        orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n")), orders.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n")),
        orders.union(orders), orders.intersect(orders), orders.intersectAll(orders), orders.exceptAll(orders), orders.subtract(orders),
        orders.dropDuplicates(["o_custkey"]), orders.dropDuplicates(["o_orderkey"]), spark.range(5), spark.range(6), spark.range(1, 6),
    ]
    found = [digest(df) for df in different]
    assert None not in found and len(set(found)) == len(found)


def test_plans_without_identity(spark):
    orders = read(spark, "orders")
    orders.createOrReplaceTempView("orders_seen")
    local = spark.createDataFrame([(1,)], "a int")

    class State:
        pass

    state = State()

    @F.udf("long")
    def opaque(x):
        return x + id(state)

    frames = [
        local, local.join(orders, F.col("a") == F.col("o_custkey")), orders.select(F.rand(1).alias("x")),
        orders.filter("o_custkey = (select max(o_custkey) from orders_seen)"),
    ]
    assert [digest(df) for df in frames] == [None] * len(frames)
    assert digest(orders.select(opaque("o_custkey"))) != digest(orders.select(opaque("o_custkey")))
    before = digest(orders)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert digest(orders.filter("o_custkey = 1")) != digest_in(spark, zone, orders.filter("o_custkey = 1"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert digest(orders) == before


def digest_in(spark, zone, df):
    now = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        return digest(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", now)


def test_store_and_run(spark, tmp_path, rows):
    store = ResultStore(spark, f"{tmp_path}/store")
    kept = store.store_frame(dear(spark))
    assert kept.columns == dear(spark).columns
    plan = dear(spark).groupBy("o_orderpriority").agg(F.sum("l_linenumber").alias("n"))
    again = store.run_frame(plan)
    assert rows(again) == rows(plan)
    assert all("/store/results/" in f for f in again.inputFiles())
    # a self-join reads the stored part twice; columns of one name stay apart
    def twice():
        a, b = dear(spark).alias("a"), dear(spark).alias("b")
        return a.join(b, F.col("a.l_orderkey") == F.col("b.o_orderkey")).select("a.o_custkey", "b.l_linenumber", "b.o_custkey")

    double = store.run_frame(twice())
    assert rows(double) == rows(twice())
    assert store.catalog().first()["reuse"] == 3
    # what differs is not found
    other = dear(spark, 100001)
    assert store.run_frame(other) is other
    with pytest.raises(ValueError, match="identity"):
        store.store_frame(spark.createDataFrame([(1,)], "a int"))


def test_largest_part_wins(spark, tmp_path, rows):
    store = ResultStore(spark, f"{tmp_path}/store")
    store.store_frame(read(spark, "orders").filter(F.col("o_totalprice") > 100000))
    store.store_frame(dear(spark))
    store.run_frame(dear(spark).select("o_orderkey"))
    reuse = {r["n_nodes"]: r["reuse"] for r in store.catalog().collect()}
    assert reuse == {2: 0, 5: 1}


def test_changed_files_are_not_reused(spark, tmp_path, rows):
    import os

    path = f"{tmp_path}/table"

    def counted():
        return spark.read.parquet(path).groupBy().count()

    spark.range(10).coalesce(1).write.parquet(path)
    store = ResultStore(spark, f"{tmp_path}/store")
    store.store_frame(counted())
    assert "/store/results/" in store.run_frame(counted()).inputFiles()[0]
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert rows(store.run_frame(counted())) == [(15,)]
    store.store_frame(counted())
    file = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.utime(f"{path}/{file}", (1, 1))
    df = counted()
    assert store.run_frame(df) is df


def test_python_functions_over_batches(spark, tmp_path, rows):
    def doubled(k):
        def run(batches):
            import pyarrow.compute as pc

            for b in batches:
                yield b.set_column(0, "id", pc.multiply(b.column(0), k))

        return spark.range(20).mapInArrow(run, "id long")

    assert digest(doubled(2)) == digest(doubled(2)) != digest(doubled(3))
    store = ResultStore(spark, f"{tmp_path}/store")
    store.store_frame(doubled(2))
    assert rows(store.run_frame(doubled(2).filter("id > 4"))) == rows(doubled(2).filter("id > 4"))
    assert store.catalog().first()["reuse"] == 1


def test_nodes_of_frames_match(spark):
    a = frame_nodes(dear(spark), "a")
    b = frame_nodes(dear(spark).groupBy("o_orderpriority").count(), "b")
    c = frame_nodes(dear(spark, 5), "c")
    nodes = a.unionByName(b).unionByName(c)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "job_a string, job_b string")
    got = {r["job_b"]: r["matched"] for r in plans.match_plans(nodes, pairs).collect()}
    assert got == {"b": 5, "c": 2}
    scans = nodes.filter("op = 'scan'").collect()
    assert all(len(r["inputs"]) == len(r["mtimes"]) == 1 for r in scans) and len(scans) == 6


def module(name, source):
    made = types.ModuleType(name)
    exec(source, made.__dict__)
    sys.modules[name] = made
    return made


def test_identity_reaches_through_modules():
    m = module("kl_probe", "LIMIT = 1\ndef f(df):\n    return df.filter(f'a > {LIMIT}')\n")

    def step(df):
        return m.f(df)

    def late(df):
        import kl_probe

        return kl_probe.f(df)

    def named(df):
        from kl_probe import f

        return f(df)

    try:
        before = [function_identity(g) for g in (step, late, named)]
        assert before == [function_identity(g) for g in (step, late, named)]
        m.LIMIT = 2
        changed = [function_identity(g) for g in (step, late, named)]
        assert all(x != y for x, y in zip(before, changed))
        m.LIMIT = 1
        assert before == [function_identity(g) for g in (step, late, named)]
        exec("def f(df):\n    return df.filter('a > 2')\n", m.__dict__)
        assert all(x != y for x, y in zip(before, [function_identity(g) for g in (step, late, named)]))
    finally:
        del sys.modules["kl_probe"]
    assert function_identity(lambda df: F.col("a")) == function_identity(lambda df: F.col("a"))
