"""Exact aggregates, built-in and with Python functions, histograms and quantiles."""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import batches, combine, distributions
from ..plans.shared import materialise
from .registry import Tables, one_row, query


@query("reduce_sum", "SELECT CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem")
def _(t: Tables):
    return one_row(t.spark, "total double", combine.reduce(t.lineitem, "l_quantity", operator.add))


@query("tree_reduce", "SELECT max(o_totalprice) AS largest FROM orders")
def _(t: Tables):
    return one_row(t.spark, "largest double", combine.tree_reduce(t.orders, "o_totalprice", max, depth=3))


@query("fold_sum", "SELECT CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def _(t: Tables):
    return one_row(t.spark, "total long", combine.fold(t.orders, "o_orderkey", 0, operator.add))


@query(
    "aggregate_multi",
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total, max(p_size) AS largest FROM part""",
)
def _(t: Tables):
    def add(acc, size):
        return {"n": acc["n"] + 1, "total": acc["total"] + size, "largest": max(acc["largest"], size)}

    def merge(a, b):
        return {
            "n": a["n"] + b["n"], "total": a["total"] + b["total"],
            "largest": max(a["largest"], b["largest"]),
        }

    zero = {"n": 0, "total": 0, "largest": 0}
    answer = combine.aggregate(
        t.part, zero, add, merge, "struct<n: bigint, total: bigint, largest: int>", "p_size"
    )
    return one_row(t.spark, "n long, total long, largest int", *answer.values())


@query("tree_aggregate", "SELECT CAST(sum(p_size) AS BIGINT) AS total FROM part")
def _(t: Tables):
    total = combine.tree_aggregate(t.part, 0, operator.add, operator.add, "bigint", "p_size", depth=2)
    return one_row(t.spark, "total long", total)


@query("count_rows", "SELECT count(*) AS count FROM lineitem")
def _(t: Tables):
    return agg.count_rows(t.lineitem)


@query("count_by_value", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def _(t: Tables):
    return agg.count_by_value(t.events, "event_type")


@query(
    "max_min",
    "SELECT max(l_extendedprice) AS max, min(l_extendedprice) AS min FROM lineitem",
)
def _(t: Tables):
    return agg.max_min(t.lineitem, "l_extendedprice")


@query(
    "combine_by_key",
    """SELECT l_suppkey, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables):
    pairs = combine.combine_by_key(
        t.lineitem.select("l_suppkey", "l_quantity"),
        "l_suppkey",
        lambda v: {"s": v["l_quantity"], "n": 1},
        lambda c, v: {"s": c["s"] + v["l_quantity"], "n": c["n"] + 1},
        lambda a, b: {"s": a["s"] + b["s"], "n": a["n"] + b["n"]},
        "struct<s: double, n: bigint>",
    )
    return pairs.select("l_suppkey", F.round(F.col("value.s") / F.col("value.n"), 6).alias("mean"))


@query(
    "aggregate_by_key",
    "SELECT l_suppkey, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_suppkey",
)
def _(t: Tables):
    """Distinct small numbers per key as a bit set."""
    bits = combine.aggregate_by_key(
        t.lineitem.select("l_suppkey", "l_linenumber"),
        "l_suppkey",
        0,
        lambda acc, v: acc | (1 << v["l_linenumber"]),
        operator.or_,
        "bigint",
    )
    return bits.select("l_suppkey", F.bit_count("value").cast("long").alias("numbers"))


@query(
    "fold_by_key",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY o_custkey""",
)
def _(t: Tables):
    folded = agg.fold_by_key(t.orders, "o_custkey", "o_totalprice", 0.0)
    return folded.select("o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "reduce_by_key",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n,
       max(l_extendedprice) AS largest, round(avg(l_discount), 6) AS avg_disc
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(t: Tables):
    return agg.reduce_by_key(
        t.lineitem,
        ["l_returnflag", "l_linestatus"],
        sum_qty=F.sum("l_quantity"),
        n=F.count(F.lit(1)),
        largest=F.max("l_extendedprice"),
        avg_disc=F.round(F.avg("l_discount"), 6),
    )


@query(
    "reduce_by_key_locally",
    "SELECT l_returnflag AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1",
)
def _(t: Tables):
    answer = agg.reduce_by_key_locally(t.lineitem, "l_returnflag", F.sum("l_quantity"))
    return t.spark.createDataFrame(list(answer.items()), "k string, v double")


@query("count_by_key", "SELECT nullif(o_custkey, 7) AS k, count(*) AS count FROM orders GROUP BY 1")
def _(t: Tables):
    return agg.count_by_key(t.orders.select(F.nullif("o_custkey", F.lit(7)).alias("k")), "k")


def _listed(grouped, key: str):
    """One row per key with its values in order."""
    values = F.array_sort(F.transform("values", lambda v: v["o_orderkey"]))
    return grouped.select(key, F.array_join(values, "|").alias("orders"))


_LISTED = """SELECT {key} AS {name}, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS orders
       FROM orders GROUP BY 1"""


@query("group_by_key", _LISTED.format(key="o_custkey", name="o_custkey"))
def _(t: Tables):
    return _listed(agg.group_by_key(t.orders.select("o_custkey", "o_orderkey"), "o_custkey"), "o_custkey")


@query("group_by_key_chunks", _LISTED.format(key="o_custkey", name="o_custkey"))
def _(t: Tables):
    """Chunks of about five rows, put together again."""
    chunks = agg.group_by_key_chunks(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", rows_per_chunk=5)
    whole = chunks.groupBy("o_custkey").agg(F.flatten(F.collect_list("values")).alias("values"))
    return _listed(whole, "o_custkey")


@query("group_by_expr", _LISTED.format(key="CAST(year(o_orderdate) AS INTEGER)", name="key"))
def _(t: Tables):
    return _listed(agg.group_by(t.orders.select("o_orderkey", "o_orderdate"), F.year("o_orderdate")), "key")


@query(
    "collect_as_map",
    "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
)
def _(t: Tables):
    return agg.collect_as_map(t.orders, "o_custkey", "o_totalprice", "o_orderkey")


@query("sum_double", "SELECT round(coalesce(sum(value), 0), 4) AS sum FROM events")
def _(t: Tables):
    return agg.sum_double(t.events, "value").select(F.round("sum", 4).alias("sum"))


_STATS = """count({c}) AS count, round(avg({c}), 6) AS mean, round(sum({c}), 3) AS sum,
 max({c}) AS max, min({c}) AS min, round(var_pop({c}), 4) AS variance,
 round(var_samp({c}), 4) AS sample_variance, round(stddev_pop({c}), 6) AS stdev,
 round(stddev_samp({c}), 6) AS sample_stdev"""
_DIGITS = {
    "mean": 6, "sum": 3, "variance": 4, "sample_variance": 4, "stdev": 6, "sample_stdev": 6,
}


def _rounded(df):
    return df.select(*[F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else F.col(c) for c in df.columns])


@query("stats", "SELECT " + _STATS.format(c="value") + " FROM events")
def _(t: Tables):
    return _rounded(agg.stats(t.events, "value"))


@query(
    "variance_family",
    """SELECT round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS variance,
       round(stddev_pop(l_quantity), 6) AS stdev, round(stddev_samp(l_quantity), 6) AS sample_stdev,
       round(var_samp(l_quantity), 4) AS sample_variance FROM lineitem""",
)
def _(t: Tables):
    return _rounded(agg.variance_family(t.lineitem, "l_quantity"))


@query(
    "histogram_even",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
       h AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS i, count(*) AS n
             FROM lineitem, b GROUP BY 1)
       SELECT CAST(s.i AS INTEGER) AS bucket, round(lo + (hi - lo) * s.i / 10, 6) AS low, coalesce(n, 0) AS count
       FROM b, (SELECT unnest(generate_series(0, 9)) AS i) s LEFT JOIN h ON h.i = s.i""",
)
def _(t: Tables):
    return distributions.histogram(t.lineitem, "l_extendedprice", 10).select(
        "bucket", F.round("low", 6).alias("low"), "count"
    )


@query(
    "histogram_edges",
    """WITH e AS (SELECT * FROM (VALUES (0, 0.0, 5.0), (1, 5.0, 11.0), (2, 11.0, 24.0), (3, 24.0, 50.0)) v(bucket, low, high))
       SELECT bucket, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(l_quantity) AS count
       FROM e LEFT JOIN lineitem ON l_quantity >= low AND (l_quantity < high OR (bucket = 3 AND l_quantity = high))
       GROUP BY bucket, low, high""",
)
def _(t: Tables):
    return distributions.histogram_edges(t.lineitem, "l_quantity", [0, 5, 11, 24, 50])


@query(
    "is_empty",
    """SELECT (SELECT count(*) FROM lineitem) = 0 AS all_rows,
       (SELECT count(*) FROM lineitem WHERE l_quantity < 0) = 0 AS none_negative""",
)
def _(t: Tables):
    return one_row(
        t.spark,
        "all_rows boolean, none_negative boolean",
        agg.is_empty(t.lineitem),
        agg.is_empty(t.lineitem.filter("l_quantity < 0")),
    )


_QUANTILES = """WITH r AS (SELECT {g} AS g, {c} AS v, row_number() OVER (PARTITION BY {g} ORDER BY {c}) - 1 AS i,
 count(*) OVER (PARTITION BY {g}) AS n FROM {t}),
 p AS (SELECT CAST(unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS p)"""


@query(
    "closest_quantiles",
    _QUANTILES.format(g="l_returnflag", c="l_extendedprice", t="lineitem")
    + " SELECT g AS l_returnflag, p AS probability, v AS value FROM r, p"
    " WHERE i = least(CAST(floor(p * n) AS BIGINT), n - 1)",
)
def _(t: Tables):
    return distributions.closest_quantiles(t.lineitem, "l_extendedprice", by="l_returnflag")


@query(
    "distribution_summary",
    _QUANTILES.format(g="event_type", c="value", t="events")
    + """, q AS (SELECT g, p, v FROM r, p WHERE i = least(CAST(floor(p * n) AS BIGINT), n - 1)),
     w AS (SELECT g, max(v) FILTER (p = 0) AS q0, max(v) FILTER (p = 0.25) AS q25, max(v) FILTER (p = 0.5) AS q50,
           max(v) FILTER (p = 0.75) AS q75, max(v) FILTER (p = 1) AS q100 FROM q GROUP BY g),
     s AS (SELECT event_type, """
    + _STATS.format(c="value")
    + """ FROM events GROUP BY event_type)
     SELECT s.*, q0, q25, q50, q75, q100 FROM s JOIN w ON g = event_type""",
)
def _(t: Tables):
    return _rounded(distributions.distribution_summary(t.events, "value", "event_type"))


def _rank_error(t: Tables, points):
    """How far the rank of each found value is from the wanted one, as a share of its group."""
    values = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("x"))
    # a few rows for each of three flags
    both = values.join(F.broadcast(points), "l_returnflag").groupBy("l_returnflag", "probability").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x") < F.col("value"), 1)).alias("below"),
        F.count(F.when(F.col("x") <= F.col("value"), 1)).alias("upto"),
    )
    wanted = F.col("probability") * F.col("n")
    off = F.greatest(F.col("below") - wanted, wanted - F.col("upto"), F.lit(0.0)) / F.col("n")
    return both.withColumn("off", off)


_RANKS = """SELECT l_returnflag, p AS probability, count(*) AS n, true AS close
 FROM lineitem, unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS q(p) GROUP BY ALL"""


@query("sketched_quantiles", _RANKS)
def _(t: Tables):
    points = distributions.sketched_quantiles(
        t.lineitem, {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity")}, by="l_returnflag", accuracy=1000
    )
    checked = _rank_error(t, points.filter("metric = 'price'").drop("metric"))
    return checked.select("l_returnflag", "probability", "n", (F.col("off") <= 0.001 + 1 / F.col("n")).alias("close"))


@query("quantile_sketch_union", _RANKS)
def _(t: Tables):
    """Quantiles from stored sketches of eight parts."""
    lines = t.lineitem.withColumn("part", F.col("l_orderkey") % 8)
    parts = materialise(distributions.quantile_sketches(lines, "l_extendedprice", ["l_returnflag", "part"]), "sketches")
    points = distributions.quantiles_of(distributions.unite_quantile_sketches(parts, "l_returnflag"))
    checked = _rank_error(t, points)
    # three deviations of sketches with k = 200
    return checked.select("l_returnflag", "probability", "n", (F.col("off") <= 0.05).alias("close"))


def _sums(starts, c):
    """Combiners of order lines: sums, and the largest number."""
    ones = np.add.reduceat(np.ones(len(c["l_quantity"]), np.int64), starts)
    quantity = np.add.reduceat(c["l_quantity"], starts)
    return {"n": ones, "quantity": quantity, "largest": np.maximum.reduceat(c["l_linenumber"], starts)}


def _merged_sums(starts, c):
    added = {k: np.add.reduceat(c[k], starts) for k in ("n", "quantity")}
    return {**added, "largest": np.maximum.reduceat(c["largest"], starts)}


_COMBINER = "n long, quantity double, largest long"
_SUMS = """count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(max(l_linenumber) AS BIGINT) AS largest
 FROM lineitem"""


@query("combine_batches_by_key", f"SELECT l_suppkey, l_returnflag, {_SUMS} GROUP BY 1, 2")
def _(t: Tables):
    lines = t.lineitem.select("l_suppkey", "l_returnflag", "l_quantity", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return batches.combine_batches_by_key(lines, ["l_suppkey", "l_returnflag"], _sums, _merged_sums, _COMBINER)


@query("aggregate_batches", f"SELECT {_SUMS}")
def _(t: Tables):
    lines = t.lineitem.select("l_quantity", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    found = batches.aggregate_batches(lines, _sums, _merged_sums, _COMBINER, depth=3)
    return one_row(t.spark, _COMBINER, *found.values())
