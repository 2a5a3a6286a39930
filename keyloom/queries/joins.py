"""Joins and cogroups. Null keys come from ``nullif`` on real keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from .registry import Tables, query

_SIDES = """WITH l AS (SELECT nullif(o_custkey, 7) AS k, o_orderkey, o_orderstatus FROM orders),
 r AS (SELECT nullif(c_custkey, 11) AS k, c_name, c_mktsegment FROM customer) """


def _sides(t: Tables):
    left = t.orders.select(
        F.nullif("o_custkey", F.lit(7)).alias("k"), "o_orderkey", "o_orderstatus"
    )
    right = t.customer.select(F.nullif("c_custkey", F.lit(11)).alias("k"), "c_name", "c_mktsegment")
    return left, right


def _sql(how: str, key: str) -> str:
    return (
        _SIDES + f"SELECT {key} AS k, o_orderkey, o_orderstatus, c_name, c_mktsegment "
        f"FROM l {how} JOIN r ON l.k IS NOT DISTINCT FROM r.k"
    )


@query("join_inner", _sql("", "l.k"))
def _(t: Tables):
    return joins.join(*_sides(t), "k")


@query("join_left", _sql("LEFT", "l.k"))
def _(t: Tables):
    return joins.left_outer_join(*_sides(t), "k")


@query("join_right", _sql("RIGHT", "r.k"))
def _(t: Tables):
    return joins.right_outer_join(*_sides(t), "k")


# each side of the full join is made of an outer join, which SQL engines accept null-safe
@query(
    "join_full",
    _SIDES
    + """SELECT l.k, o_orderkey, o_orderstatus, c_name, c_mktsegment
     FROM l LEFT JOIN r ON l.k IS NOT DISTINCT FROM r.k
     UNION ALL SELECT r.k, NULL, NULL, c_name, c_mktsegment FROM r
     WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k IS NOT DISTINCT FROM r.k)""",
)
def _(t: Tables):
    return joins.full_outer_join(*_sides(t), "k")


@query("cartesian", "SELECT s_suppkey, s_name, r_regionkey, r_name FROM supplier, region")
def _(t: Tables):
    return joins.cartesian(t.supplier.select("s_suppkey", "s_name"), t.region)


def _sorted_lists(grouped, key: str, sides: dict[str, str]):
    """One row per key with the values of each side in order; two rows of a key would show."""

    def listed(side: str, field: str):
        values = F.transform(side, lambda v: v[field].cast("string"))
        return F.array_join(F.array_sort(values), "|").alias(side)

    return grouped.select(F.col(key), *[listed(s, f) for s, f in sides.items()])


def _list_sql(tables: dict[str, tuple[str, str, str]]) -> str:
    """Each side as (table, key, value), its values as one sorted text."""
    rows = " UNION ALL ".join(
        f"SELECT {key} AS k, {', '.join((f'CAST({value} AS VARCHAR)' if s == side else 'NULL') + f' AS {s}' for s in tables)} FROM {table}"
        for side, (table, key, value) in tables.items()
    )
    lists = ", ".join(f"coalesce(string_agg({s}, '|' ORDER BY {s}), '') AS {s}" for s in tables)
    return f"SELECT k, {lists} FROM ({rows}) GROUP BY k"


_NATIONS = {
    "customers": ("customer", "nullif(c_nationkey, 3)", "c_name"),
    "suppliers": ("supplier", "nullif(s_nationkey, 3)", "s_name"),
    "nations": ("nation", "n_nationkey", "n_name"),
}
_ORDER_LINES = {"orders": ("orders", "o_orderkey", "o_orderstatus"), "lines": ("lineitem", "l_orderkey", "l_linenumber")}


def _order_lines(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return [orders, t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber")]


@query("cogroup2", _list_sql(_ORDER_LINES))
def _(t: Tables):
    grouped = joins.cogroup(_order_lines(t), "k", list(_ORDER_LINES))
    return _sorted_lists(grouped, "k", {s: v[2] for s, v in _ORDER_LINES.items()})


@query("cogroup_chunks", _list_sql(_ORDER_LINES))
def _(t: Tables):
    """Chunks of four rows, put together again."""
    sides = list(_ORDER_LINES)
    chunks = joins.cogroup_chunks(_order_lines(t), "k", sides, rows_per_chunk=4)
    whole = chunks.groupBy("k").agg(*[F.flatten(F.collect_list(s)).alias(s) for s in sides])
    return _sorted_lists(whole, "k", {s: v[2] for s, v in _ORDER_LINES.items()})


def _nations(t: Tables):
    customers = t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_name")
    suppliers = t.supplier.select(F.nullif("s_nationkey", F.lit(3)).alias("k"), "s_name")
    nations = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    return customers, suppliers, nations


@query("cogroup3", _list_sql(_NATIONS))
def _(t: Tables):
    return _sorted_lists(joins.cogroup(_nations(t), "k", list(_NATIONS)), "k", {s: v[2] for s, v in _NATIONS.items()})


_SIZES = _NATIONS | {"sizes": ("part", "p_size", "p_name")}


@query("cogroup4", _list_sql(_SIZES))
def _(t: Tables):
    sizes = t.part.select(F.col("p_size").alias("k"), "p_name")
    grouped = joins.group_with([*_nations(t), sizes], "k", names=list(_SIZES))
    return _sorted_lists(grouped, "k", {s: v[2] for s, v in _SIZES.items()})


@query(
    "subtract_by_key",
    """SELECT o_custkey AS k, o_orderkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""",
)
def _(t: Tables):
    orders = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey")
    rich = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return joins.subtract_by_key(orders, rich, "k")


@query(
    "join_broadcast",
    """SELECT c_nationkey AS k, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t: Tables):
    customers = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey")
    nations = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    return joins.broadcast_join(customers, nations, "k")
