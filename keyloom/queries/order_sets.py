"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import order, positions, sets
from ..plans.keys import cols
from .registry import Tables, one_row, query


def _ranked(ordered, columns: list[str]):
    """Make the order of a sorted dataset visible as a column."""
    return positions.zip_with_index(ordered, name="rank").select(*columns, "rank")


@query(
    "sort_by_key",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders",
)
def _(t: Tables):
    return _ranked(order.sort_by_key(t.orders.select("o_orderkey"), "o_orderkey"), ["o_orderkey"])


@query(
    "sort_by_expr",
    """SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate) DESC, o_orderkey DESC) - 1 AS rank
       FROM orders""",
)
def _(t: Tables):
    by = [F.year("o_orderdate"), F.col("o_orderkey")]
    ordered = order.sort_by(t.orders.select("o_orderkey", "o_orderdate"), by, ascending=False)
    return _ranked(ordered, ["o_orderkey"])


@query("partition_sort", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS inversions FROM lineitem")
def _(t: Tables):
    """Rows that are smaller than the row before them in their partition."""
    placed = order.repartition_and_sort_within_partitions(
        t.lineitem.select("l_suppkey", "l_orderkey"), "l_suppkey", sort_by=["l_suppkey", "l_orderkey"]
    )

    def inversions(batches):
        last, n, wrong = None, 0, 0
        for b in batches:
            keys = b["l_suppkey"].to_numpy() * 2**40 + b["l_orderkey"].to_numpy()
            if len(keys):
                wrong += int((np.diff(keys) < 0).sum()) + int(last is not None and keys[0] < last)
                n, last = n + len(keys), keys[-1]
        yield pd.DataFrame({"n": [n], "inversions": [wrong]})

    counts = placed.mapInPandas(inversions, "n long, inversions long")
    return counts.agg(F.sum("n").alias("n"), F.sum("inversions").alias("inversions"))


@query("take_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def _(t: Tables):
    return order.take(t.orders, 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("first_row", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(t: Tables):
    rows = t.orders.select("o_orderkey", (-F.col("o_totalprice")).alias("p"))
    return one_row(t.spark, "o_orderkey long", order.first(rows, ["p", "o_orderkey"])["o_orderkey"])


@query(
    "top_n",
    """SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10""",
)
def _(t: Tables):
    return order.top(t.orders.select("o_totalprice", "o_orderkey"), 10, ["o_totalprice", "o_orderkey"])


@query(
    "take_ordered",
    """SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10""",
)
def _(t: Tables):
    rows = t.orders.select("o_totalprice", "o_orderkey")
    return order.take_ordered(rows, 10, ["o_totalprice", "o_orderkey"])


_A = "SELECT nullif(o_custkey, 7) AS k FROM orders"
_B = "SELECT nullif(c_custkey, 11) AS k FROM customer WHERE c_acctbal > 0"


def _bags(t: Tables):
    a = t.orders.select(F.nullif("o_custkey", F.lit(7)).alias("k"))
    b = t.customer.filter("c_acctbal > 0").select(F.nullif("c_custkey", F.lit(11)).alias("k"))
    return a, b


@query("union_all", f"{_A} UNION ALL {_B} UNION ALL {_A}")
def _(t: Tables):
    a, b = _bags(t)
    return sets.union([a, b, a])


@query("intersection", f"{_A} INTERSECT {_B}")
def _(t: Tables):
    return sets.intersection(*_bags(t))


@query(
    "subtract_rows",
    f"""WITH a AS ({_A}), b AS ({_B})
        SELECT k FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)""",
)
def _(t: Tables):
    return sets.subtract(*_bags(t))


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t: Tables):
    return sets.distinct(t.lineitem.select(*cols(["l_suppkey", "l_returnflag", "l_linestatus"])))
