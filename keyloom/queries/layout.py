"""Partitioning and layout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates, bucketed, clustered, joins, layout, project, sets
from ..plans.shared import discard_on_exit, scratch_path
from .registry import Tables, query

_WHOLE = "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, {p} AS partitions FROM orders"


def _whole(df):
    placed = project.with_partition_index(df.select("o_orderkey"))
    return placed.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_orderkey").alias("key_sum"),
        F.count_distinct("partition").alias("partitions"),
    )


@query("repartition_counts", _WHOLE.format(p="CAST(6 AS BIGINT)"))
def _(t: Tables):
    return _whole(layout.repartition(t.orders, 6))


@query("coalesce_rows", _WHOLE.format(p="CAST(3 AS BIGINT)"))
def _(t: Tables):
    return _whole(layout.coalesce(layout.repartition(t.orders, 8), 3))


@query("custom_partition", _WHOLE.format(p="CAST(5 AS BIGINT)"))
def _(t: Tables):
    return _whole(layout.custom_partition(t.orders, 5, F.col("o_orderkey") % 5))


@query(
    "hash_partition",
    "SELECT count(DISTINCT nullif(o_custkey, 7)) + 1 AS keys, CAST(0 AS BIGINT) AS split_keys FROM orders",
)
def _(t: Tables):
    keys = t.orders.select(F.nullif("o_custkey", F.lit(7)).alias("k"))
    placed = project.with_partition_index(layout.hash_partition(keys, "k", 8))
    per_key = placed.groupBy("k").agg((F.min("partition") != F.max("partition")).alias("is_split"))
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("is_split"), 1)).alias("split_keys")
    )


@query("range_partition", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS overlaps FROM orders")
def _(t: Tables):
    """Ranges of different partitions do not overlap."""
    placed = project.with_partition_index(layout.range_partition(t.orders, "o_totalprice", 8))
    ranges = placed.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("z")
    )
    other = ranges.select(F.col("partition").alias("p2"), F.col("a").alias("a2"))
    overlap = (F.col("p2") == F.col("partition") + 1) & (F.col("a2") <= F.col("z"))
    return ranges.join(other, overlap, "left").agg(
        F.sum("n").alias("n"), F.count("p2").alias("overlaps")
    )


@query(
    "range_bounds",
    """WITH w AS (SELECT o_custkey AS key, count(*) AS w FROM orders GROUP BY 1),
       c AS (SELECT key, row_number() OVER (ORDER BY key) AS pos,
             CAST(sum(w) OVER (ORDER BY key) * 8 // sum(w) OVER () AS BIGINT) AS reached FROM w),
       g AS (SELECT key, pos + least(0, min(reached - pos) OVER (ORDER BY key)) AS taken FROM c),
       b AS (SELECT key, taken, lag(taken, 1, 0) OVER (ORDER BY key) AS before FROM g)
       SELECT CAST(taken AS INTEGER) AS bound, key FROM b WHERE taken > before AND taken < 8""",
)
def _(t: Tables):
    return layout.range_bounds(t.orders, "o_custkey", 8)


@query(
    "range_bounds_sampled",
    """SELECT true AS balanced, 7 AS bounds, count(*) AS n FROM orders""",
)
def _(t: Tables):
    bounds = layout.range_bounds(t.orders, "o_orderkey", 8, fraction=0.25, seed=1)
    cuts = bounds.agg(F.array_sort(F.collect_list("key")).alias("cuts"), F.count(F.lit(1)).cast("int").alias("bounds"))
    placed = t.orders.select("o_orderkey").crossJoin(F.broadcast(cuts))  # one row of seven bounds
    ranges = placed.groupBy("bounds", F.size(F.filter("cuts", lambda c: c < F.col("o_orderkey"))).alias("range")).count()
    even = F.max("count") < 3 * F.min("count")
    return ranges.groupBy("bounds").agg(even.alias("balanced"), F.sum("count").alias("n"))


@query("partition_subset", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders")
def _(t: Tables):
    placed = layout.hash_partition(t.orders.select("o_orderkey"), "o_orderkey", 8)
    low = layout.partition_subset(placed, [0, 1, 2, 3])
    high = layout.partition_subset(placed, [4, 5, 6, 7])
    return low.unionByName(high).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("range_bounds_sketch", "SELECT 8 AS ranges, count(*) AS n, true AS balanced FROM orders")
def _(t: Tables):
    """Bounds from a sketch of partitions of which one has nine tenths of the rows."""
    place = F.when(F.col("o_orderkey") % 10 < 9, 0).otherwise(F.col("o_orderkey") % 8)
    skewed = layout.custom_partition(t.orders.select("o_orderkey", "o_totalprice"), 8, place)
    bounds = layout.range_bounds_sketched(skewed, "o_totalprice", 8, per_range=200, seed=1)
    cuts = bounds.agg(F.array_sort(F.collect_list("key")).alias("cuts"))
    placed = t.orders.select("o_totalprice").crossJoin(F.broadcast(cuts))  # one row of seven bounds
    ranges = placed.groupBy(F.size(F.filter("cuts", lambda c: c < F.col("o_totalprice"))).alias("range")).count()
    return ranges.agg(
        F.count(F.lit(1)).cast("int").alias("ranges"), F.sum("count").alias("n"),
        (F.max("count") < 3 * F.min("count")).alias("balanced"),
    )


def _clustered(t: Tables, keys: str | list[str], by: str) -> str:
    path = scratch_path(t.spark, "clustered")
    discard_on_exit(t.spark, path)
    clustered.write_clustered(t.orders, path, keys, files=16, by=by)
    return path


@query("clustered_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def _(t: Tables):
    path = _clustered(t, "o_custkey", "hash")
    return clustered.lookup(t.spark, path, "o_custkey", 42).select("o_orderkey", "o_totalprice")


@query(
    "clustered_range",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""",
)
def _(t: Tables):
    path = _clustered(t, "o_orderdate", "range")
    return clustered.filter_by_range(
        t.spark, path, "o_orderdate", F.lit("1997-01-01"), F.lit("1997-12-31")
    ).select("o_orderkey", "o_orderdate")


@query(
    "clustered_two_keys",
    """SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""",
)
def _(t: Tables):
    path = _clustered(t, ["o_orderpriority", "o_orderstatus"], "range")
    return clustered.lookup(t.spark, path, ["o_orderpriority", "o_orderstatus"], ["1-URGENT", "F"]).select("o_orderkey")


def _bucketed(t: Tables, df, key: str, buckets: int = 8):
    path = scratch_path(t.spark, "bucketed")
    discard_on_exit(t.spark, path)
    name = f"keyloom_{uuid.uuid4().hex}"
    bucketed.write_bucketed(df, name, key, buckets, path)
    return bucketed.read_bucketed(t.spark, name)


@query(
    "bucketed_join",
    """SELECT o_orderkey AS key, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t: Tables):
    """A join and a sum over two tables in buckets of the order's number: no row moves."""
    orders = _bucketed(t, t.orders.select(F.col("o_orderkey").alias("key"), "o_custkey"), "key")
    lines = _bucketed(t, t.lineitem.select(F.col("l_orderkey").alias("key"), "l_linenumber"), "key")
    both = joins.join(orders.hint("merge"), lines, "key", null_safe=False)
    return aggregates.reduce_by_key(both, "key", n=F.count(F.lit(1)), numbers=F.sum("l_linenumber"))


@query(
    "bucketed_union",
    "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY 1",
)
def _(t: Tables):
    """Two halves of a table in equal buckets, united and added up by key."""
    lines = t.lineitem.select("l_suppkey", "l_linenumber")
    halves = [_bucketed(t, lines.filter(F.col("l_linenumber") % 2 == i), "l_suppkey") for i in (0, 1)]
    return aggregates.reduce_by_key(
        sets.union(halves), "l_suppkey", n=F.count(F.lit(1)), numbers=F.sum("l_linenumber")
    )
