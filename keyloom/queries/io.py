"""Sources and sinks. File queries write a table with Spark and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks, sources
from ..operators import shared_variables as shared
from ..plans.shared import discard_on_exit, scratch_path
from .registry import Tables, one_row, query

TEXT_INPUT = "org.apache.hadoop.mapred.TextInputFormat"
NEW_TEXT_INPUT = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat"
TEXT_OUTPUT = "org.apache.hadoop.mapred.TextOutputFormat"
NEW_TEXT_OUTPUT = "org.apache.hadoop.mapreduce.lib.output.TextOutputFormat"
LONG, TEXT = "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"


def _scratch(t: Tables, tag: str) -> str:
    return scratch_path(t.spark, tag)


@query(
    "from_rows",
    """SELECT label, count(*) AS n FROM lineitem
       JOIN (VALUES ('A','accepted'),('N','none'),('R','returned')) f(flag, label)
       ON l_returnflag = flag GROUP BY label""",
)
def _(t: Tables):
    rows = [("A", "accepted"), ("N", "none"), ("R", "returned")]
    labels = sources.from_rows(t.spark, rows, "flag string, label string", 2)
    joined = t.lineitem.join(F.broadcast(labels), F.col("l_returnflag") == F.col("flag"))
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "range_source",
    """SELECT count(*) AS missing, CAST(coalesce(sum(id), 0) AS BIGINT) AS id_sum
       FROM (SELECT unnest(generate_series(0, (SELECT max(o_orderkey) FROM orders))) AS id)
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id)""",
)
def _(t: Tables):
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    ids = sources.range_source(t.spark, 0, last + 1)
    missing = ids.join(t.lineitem.select(F.col("l_orderkey").alias("id")), "id", "left_anti")
    return missing.agg(
        F.count(F.lit(1)).alias("missing"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum")
    )


@query("empty_source", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t: Tables):
    lines = t.lineitem
    both = lines.unionByName(sources.empty(t.spark, lines.schema))
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_lines",
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents",
)
def _(t: Tables):
    path = _scratch(t, "lines")
    sinks.save_as_text(t.documents.select("doc_id", "text"), path)
    discard_on_exit(t.spark, path)
    row = F.from_json("value", "doc_id bigint, text string")
    return sources.text_file(t.spark, path).select(
        row["doc_id"].alias("doc_id"), F.length(row["text"]).alias("text_length")
    )


@query(
    "whole_text",
    "SELECT c_mktsegment AS segment, count(*) AS names FROM customer GROUP BY 1",
)
def _(t: Tables):
    path = _scratch(t, "whole")
    names = t.customer.select(F.col("c_name").alias("value"), F.col("c_mktsegment").alias("segment"))
    names.write.partitionBy("segment").text(path, compression="gzip")
    discard_on_exit(t.spark, path)
    files = sources.whole_text_files(t.spark, f"{path}/*")
    lines = F.size(F.filter(F.split("content", "\n"), lambda s: s != ""))
    return (
        files.select(F.regexp_extract("path", "segment=([^/]+)/", 1).alias("segment"), lines.alias("n"))
        .groupBy("segment")
        .agg(F.sum("n").cast("long").alias("names"))
    )


@query(
    "list_files",
    """SELECT c_mktsegment AS segment, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, true AS some FROM customer GROUP BY 1""",
)
def _(t: Tables):
    """Bytes of the files of each folder, from names and lengths alone."""
    path = _scratch(t, "listed")
    names = t.customer.select(F.col("c_name").alias("value"), F.col("c_mktsegment").alias("segment"))
    names.write.partitionBy("segment").text(path)
    discard_on_exit(t.spark, path)
    files = sources.list_files(t.spark, [path])
    return files.groupBy(F.regexp_extract("path", "segment=([^/]+)/", 1).alias("segment")).agg(
        F.sum("length").alias("bytes"), (F.count(F.lit(1)) > 0).alias("some")
    )


@query("binary_files", "SELECT CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes FROM customer")
def _(t: Tables):
    path = _scratch(t, "binary")
    sinks.save_as_text(t.customer, path, line=F.col("c_name"))
    discard_on_exit(t.spark, path)
    files = sources.binary_files(t.spark, path)
    return files.agg(F.sum(F.octet_length("content")).alias("bytes"))


@query(
    "fixed_records",
    """SELECT o_orderkey AS orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
)
def _(t: Tables):
    path = _scratch(t, "records")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 15, "0"), F.lpad(cents, 16, "0"))
    sinks.save_as_text(t.orders, path, line=line)
    discard_on_exit(t.spark, path)
    records = sources.fixed_records(t.spark, path, 32)
    text = F.col("record").cast("string")
    return records.select(
        F.substring(text, 1, 15).cast("long").alias("orderkey"),
        F.substring(text, 16, 16).cast("long").alias("cents"),
    )


def _hadoop_counts(t: Tables, read, input_format: str):
    path = _scratch(t, "hadoop")
    sinks.save_as_text(t.customer, path, line=F.col("c_mktsegment"))
    discard_on_exit(t.spark, path)
    pairs = read(t.spark, path, input_format, LONG, TEXT, "offset long, line string")
    return pairs.groupBy(F.col("line").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


_SEGMENTS = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"


@query("hadoop_source", _SEGMENTS)
def _(t: Tables):
    return _hadoop_counts(t, sources.hadoop_file, TEXT_INPUT)


@query("new_hadoop_source", _SEGMENTS)
def _(t: Tables):
    return _hadoop_counts(t, sources.new_hadoop_file, NEW_TEXT_INPUT)


@query("sequence_roundtrip", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t: Tables):
    path = _scratch(t, "sequence")
    sinks.save_as_sequence(t.orders.select("o_orderkey", "o_orderpriority"), path)
    discard_on_exit(t.spark, path)
    return sources.sequence_file(t.spark, path, "o_orderkey long, o_orderpriority string")


@query(
    "object_roundtrip",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
)
def _(t: Tables):
    path = _scratch(t, "objects")
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    sinks.save_as_object(orders, path)
    discard_on_exit(t.spark, path)
    return sources.object_file(t.spark, path, orders.schema)


@query(
    "jdbc_ranges",
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS len FROM orders),
       e AS (SELECT CAST(i AS INTEGER) AS i, lo + (i * len) // 8 AS a, lo + ((i + 1) * len) // 8 - 1 AS z
             FROM b, (SELECT unnest(generate_series(0, 7)) AS i))
       SELECT i AS part, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS low,
              CAST(max(o_orderkey) AS BIGINT) AS high
       FROM orders JOIN e ON o_orderkey BETWEEN a AND z GROUP BY i""",
)
def _(t: Tables):
    """The predicates of the JDBC reader, applied to the same key column."""
    orders = t.orders
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    cases = " ".join(
        f"WHEN {p} THEN {i}"
        for i, p in enumerate(sources.range_predicates("o_orderkey", low, high, 8))
    )
    return (
        orders.groupBy(F.expr(f"CASE {cases} END").alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderkey").alias("low"),
            F.max("o_orderkey").alias("high"),
        )
    )


@query("input_split_stats", "SELECT 'lineitem.parquet' AS file, count(*) AS n FROM lineitem")
def _(t: Tables):
    splits = sources.input_splits(t.lineitem).groupBy("split_path", "split_start").agg(
        F.count(F.lit(1)).alias("n")
    )
    return splits.groupBy(F.element_at(F.split("split_path", "/"), -1).alias("file")).agg(
        F.sum("n").alias("n")
    )


@query("text_roundtrip", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t: Tables):
    path = _scratch(t, "text")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority")
    sinks.save_as_text(t.orders, path, line=line, compression="gzip")
    discard_on_exit(t.spark, path)
    parts = F.split("value", r"\|")
    return sources.text_file(t.spark, path).select(
        parts[0].cast("long").alias("o_orderkey"), parts[1].alias("o_orderpriority")
    )


@query(
    "hadoop_roundtrip",
    """SELECT api, o_orderkey, o_orderstatus FROM orders, (VALUES ('new'), ('old')) v(api)""",
)
def _(t: Tables):
    pairs = t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("v"))
    old, new = _scratch(t, "old"), _scratch(t, "new")
    sinks.save_as_hadoop_file(pairs, old, TEXT_OUTPUT, TEXT, TEXT)
    sinks.save_as_new_hadoop_file(pairs, new, NEW_TEXT_OUTPUT, TEXT, TEXT)
    back = []
    for api, path in (("old", old), ("new", new)):
        discard_on_exit(t.spark, path)
        parts = F.split("value", "\t")
        back.append(
            sources.text_file(t.spark, path).select(
                F.lit(api).alias("api"),
                parts[0].cast("long").alias("o_orderkey"),
                parts[1].alias("o_orderstatus"),
            )
        )
    return back[0].unionByName(back[1])


@query(
    "foreach_accumulate",
    "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders",
)
def _(t: Tables):
    count, total = shared.accumulator(t.spark, 0), shared.accumulator(t.spark, 0)

    def effect(rows):
        n = s = 0
        for row in rows:
            n, s = n + 1, s + row[0]
        count.add(n)
        total.add(s)

    sinks.foreach_partition(t.orders.select("o_orderkey"), effect)
    return one_row(t.spark, "n long, key_sum long", count.value, total.value)
