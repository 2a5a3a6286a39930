"""Projections, filters, per-partition transforms, positions and pipes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import layout, pipe, positions, project
from .registry import Tables, query


@query(
    "project_map",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
       upper(l_returnflag) || l_linestatus AS flags FROM lineitem""",
)
def _(t: Tables):
    return project.map_rows(
        t.lineitem,
        l_orderkey=F.col("l_orderkey"),
        l_linenumber=F.col("l_linenumber"),
        net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4),
        flags=F.concat(F.upper("l_returnflag"), "l_linestatus"),
    )


@query(
    "flat_map_words",
    """SELECT doc_id, count(*) AS words, count(DISTINCT w) AS distinct_words
       FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY doc_id""",
)
def _(t: Tables):
    words = project.flat_map(t.documents, F.split("text", " "), "w", ["doc_id"])
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.count_distinct("w").alias("distinct_words")
    )


@query("filter_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def _(t: Tables):
    return project.filter_rows(t.orders, F.col("o_totalprice") > 250000).select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "map_partitions",
    "SELECT event_id, round(value * 2 + 1, 4) AS scaled FROM events",
)
def _(t: Tables):
    def scale(batches):
        for b in batches:
            yield pd.DataFrame({"event_id": b.event_id, "scaled": (b.value * 2 + 1).round(4)})

    events = t.events.select("event_id", "value")
    return project.map_partitions(events, scale, "event_id long, scaled double")


@query(
    "partition_index",
    """SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS split_keys FROM orders""",
)
def _(t: Tables):
    """After hash partitioning no key has rows in two partitions."""
    placed = project.with_partition_index(layout.hash_partition(t.orders.select("o_custkey"), "o_custkey"))
    per_key = placed.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), (F.min("partition") != F.max("partition")).alias("is_split")
    )
    return per_key.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("keys"),
        F.count(F.when(F.col("is_split"), 1)).alias("split_keys"),
    )


@query("map_with_resource", "SELECT count(*) AS n, count(*) AS in_range FROM events")
def _(t: Tables):
    def draw(generator, batch):
        return batch.assign(draw=generator.random(len(batch)))

    drawn = project.map_with(
        t.events.select("event_id"), project.seeded_generator(7), draw, "event_id long, draw double"
    )
    return drawn.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("draw").between(0, 1), 1)).alias("in_range")
    )


@query(
    "partial_map",
    """SELECT event_id, sqrt(value) AS root FROM events WHERE event_type = 'purchase' AND value >= 0""",
)
def _(t: Tables):
    defined = (F.col("event_type") == "purchase") & (F.col("value") >= 0)
    return project.partial_map(t.events, defined, event_id=F.col("event_id"), root=F.sqrt("value"))


@query(
    "key_by",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS key, o_orderkey, o_orderpriority FROM orders",
)
def _(t: Tables):
    return project.key_by(t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), F.year("o_orderdate")).drop(
        "o_orderdate"
    )


@query(
    "map_values",
    "SELECT o_custkey, round(o_totalprice / 1000, 6) AS thousands FROM orders",
)
def _(t: Tables):
    pairs = t.orders.select("o_custkey", "o_totalprice")
    return project.map_values(pairs, "o_custkey", thousands=F.round(F.col("o_totalprice") / 1000, 6))


@query(
    "flat_map_values",
    "SELECT conv_id, unnest(string_split(text, ' ')) AS word FROM conversations",
)
def _(t: Tables):
    return project.flat_map_values(
        t.conversations.select("conv_id", "text"), "conv_id", F.split("text", " "), "word"
    )


@query("keys", "SELECT l_orderkey FROM lineitem")
def _(t: Tables):
    return project.keys_of(t.lineitem, "l_orderkey")


@query("values", "SELECT l_quantity, l_tax FROM lineitem")
def _(t: Tables):
    return project.values_of(t.lineitem.select("l_orderkey", "l_quantity", "l_tax"), "l_orderkey")


@query("glom_sizes", "SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM part")
def _(t: Tables):
    arrays = project.glom(t.part.select("p_partkey"))
    keys = F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + r["p_partkey"])
    return arrays.agg(F.sum(F.size("rows")).alias("n"), F.sum(keys).alias("key_sum"))


@query(
    "filter_by_range",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""",
)
def _(t: Tables):
    day = "timestamp_ntz"
    return project.filter_by_range(
        t.orders, "o_orderdate", F.lit("1997-01-01").cast(day), F.lit("1997-12-31").cast(day)
    ).select("o_orderkey", "o_orderdate")


@query("lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def _(t: Tables):
    return project.lookup(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 42)


@query("prune_partitions", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders")
def _(t: Tables):
    """Pruning by id and by its complement gives every row once."""
    placed = layout.hash_partition(t.orders.select("o_orderkey"), "o_orderkey", 8)
    even = project.prune_partitions(placed, lambda i: i % 2 == 0, 8)
    odd = project.prune_partitions(placed, [1, 3, 5, 7])
    return even.unionByName(odd).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(
    "map_to_pair",
    "SELECT o_orderkey AS key, CAST(o_orderdate AS VARCHAR)[1:10] AS value FROM orders",
)
def _(t: Tables):
    return project.map_to_pair(
        t.orders, F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), "bigint", "string"
    )


@query("map_to_double", "SELECT CAST(l_linenumber AS DOUBLE) * l_quantity AS value FROM lineitem")
def _(t: Tables):
    return project.map_to_double(t.lineitem, F.col("l_linenumber") * F.col("l_quantity"))


@query(
    "zip_tables",
    """SELECT a.o_orderkey, b.cheap_key FROM
       (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) a JOIN
       (SELECT o_orderkey AS cheap_key, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i
        FROM orders) b ON a.i = b.i""",
)
def _(t: Tables):
    left = t.orders.select("o_orderkey")
    right = t.orders.select("o_totalprice", F.col("o_orderkey").alias("cheap_key"))
    zipped = positions.zip_tables(left, right, "o_orderkey", ["o_totalprice", "cheap_key"])
    return zipped.select("o_orderkey", "cheap_key")


@query(
    "zip_partitions",
    """SELECT coalesce(a.part, b.part) AS part, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines
       FROM (SELECT CAST(o_orderkey % 8 AS INTEGER) AS part, count(*) AS n_orders FROM orders GROUP BY 1) a
       FULL JOIN (SELECT CAST(l_orderkey % 8 AS INTEGER) AS part, count(*) AS n_lines FROM lineitem GROUP BY 1) b
       ON a.part = b.part""",
)
def _(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("key"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"))

    def counts(a, b):
        keys = pd.concat([a["key"], b["key"]])
        yield pd.DataFrame(
            {"part": [int(keys.iloc[0] % 8)], "n_orders": [len(a)], "n_lines": [len(b)]}
        )

    return positions.zip_partitions(
        [orders, lines], counts, "part int, n_orders long, n_lines long", 8, F.col("key") % 8
    )


@query(
    "zip_with_index",
    """SELECT o_orderkey, o_totalprice,
       row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS "index" FROM orders""",
)
def _(t: Tables):
    return positions.zip_with_index(
        t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]
    )


@query("zip_with_unique_id", "SELECT count(*) AS n, count(*) AS distinct_ids FROM lineitem")
def _(t: Tables):
    ids = positions.zip_with_unique_id(t.lineitem.select("l_orderkey"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct_ids"))


@query("pipe_cat", "SELECT c_name AS value, count(*) AS n FROM customer GROUP BY c_name")
def _(t: Tables):
    lines = pipe.pipe(t.customer, "cat", line=F.col("c_name"))
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


