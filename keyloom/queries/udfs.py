"""Python functions as scalar, aggregate and table functions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators import udfs
from .registry import Tables, query


@query("udf_scalar", "SELECT c_custkey, upper(c_name) || '/' || c_mktsegment AS tag FROM customer")
def _(t: Tables):
    tag = udfs.scalar(lambda name, segment: name.str.upper() + "/" + segment, "string")
    return t.customer.select("c_custkey", tag("c_name", "c_mktsegment").alias("tag"))


@query(
    "udf_group_agg",
    "SELECT l_returnflag, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_returnflag",
)
def _(t: Tables):
    lines = t.lineitem.select("l_returnflag", "l_extendedprice")
    return udfs.reduce_groups(lines, "l_returnflag", "l_extendedprice", lambda s: float(s.max()), "double")


@query(
    "udf_group_median",
    """SELECT l_suppkey, CAST(median(l_extendedprice) AS DOUBLE) AS l_extendedprice FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables):
    lines = t.lineitem.select("l_suppkey", "l_extendedprice")
    return udfs.reduce_groups(lines, "l_suppkey", "l_extendedprice", lambda s: float(s.median()), "double")


@query(
    "udf_merge_groups",
    "SELECT l_returnflag, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_returnflag",
)
def _(t: Tables):
    def largest(s):
        return float(s.max())

    lines = t.lineitem.select("l_returnflag", "l_extendedprice")
    return udfs.merge_groups(lines, "l_returnflag", "l_extendedprice", largest, largest, "double")


@query(
    "udf_map_groups",
    """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey""",
)
def _(t: Tables):
    def summary(g):
        # the key is the same in the whole group
        row = (g["o_custkey"].iat[0], len(g), g["o_totalprice"].max())
        return pd.DataFrame([row], columns=["o_custkey", "n", "largest"])

    orders = t.orders.select("o_custkey", "o_totalprice")
    return udfs.map_groups(orders, "o_custkey", summary, "o_custkey long, n long, largest double")


@query(
    "udf_map_groups_arrow",
    """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey""",
)
def _(t: Tables):
    def summary(g):
        row = {"o_custkey": g["o_custkey"][0], "n": len(g), "largest": pc.max(g["o_totalprice"])}
        return pa.table({name: pa.array([pa.scalar(v).as_py()]) for name, v in row.items()})

    orders = t.orders.select("o_custkey", "o_totalprice")
    return udfs.map_groups_arrow(orders, "o_custkey", summary, "o_custkey long, n long, largest double")


@query(
    "udtf_tokens",
    """SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
       GROUP BY token""",
)
def _(t: Tables):
    tokens = udfs.table_function(
        t.documents.select("text"), lambda text: ((w,) for w in text.split(" ")), "text", "token string"
    )
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "udtf_tokens_batches",
    """SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS token FROM documents)
       GROUP BY ALL""",
)
def _(t: Tables):
    def split(texts):
        lists = pc.split_pattern(texts, " ")
        return pc.list_parent_indices(lists), [pc.list_flatten(lists)]

    tokens = udfs.table_function_batches(t.documents.select("lang", "text"), split, "text", "token string", ["lang"])
    return tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
