"""Persistence, driver actions and shared variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions, persistence
from ..operators import shared_variables as shared
from ..plans.shared import discard_on_exit, scratch_path
from .registry import Tables, one_row, query

_BY_FLAG = "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1"


def _by_flag(lines):
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("persist_reuse", _BY_FLAG)
def _(t: Tables):
    return _by_flag(persistence.persist(t.lineitem.select("l_returnflag", "l_quantity"), "MEMORY_AND_DISK"))


@query("checkpoint_rows", _BY_FLAG)
def _(t: Tables):
    return persistence.checkpoint(_by_flag(t.lineitem))


@query("local_checkpoint_rows", _BY_FLAG)
def _(t: Tables):
    return persistence.cut_lineage(_by_flag(t.lineitem))


@query(
    "local_iterator",
    """SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       count(DISTINCT (year(o_orderdate), o_orderpriority)) AS rows_seen FROM orders""",
)
def _(t: Tables):
    """Only the sums per year and priority pass through the driver, partition by partition."""
    sums = t.orders.groupBy(F.year("o_orderdate"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s")
    )
    n = total = rows_seen = 0
    for row in actions.local_iterator(sums):
        n, total, rows_seen = n + row["n"], total + row["s"], rows_seen + 1
    return one_row(t.spark, "n long, key_sum long, rows_seen long", n, total, rows_seen)


@query("async_count", "SELECT (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS orders")
def _(t: Tables):
    lines, orders = actions.count_async(t.lineitem), actions.count_async(t.orders)
    return one_row(t.spark, "lines long, orders long", lines.result(), orders.result())


@query(
    "observe_metrics",
    "SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem",
)
def _(t: Tables):
    lines, metrics = shared.observe(t.lineitem, n=F.count(F.lit(1)), qty=F.sum("l_quantity"))
    lines.write.format("noop").mode("overwrite").save()
    return one_row(t.spark, "n long, qty double", metrics.get["n"], metrics.get["qty"])


@query("accumulate_set", "SELECT DISTINCT event_type FROM events")
def _(t: Tables):
    kinds = shared.accumulable_set(t.spark)

    def effect(rows):
        kinds.add({row[0] for row in rows})

    t.events.select("event_type").foreachPartition(effect)
    return t.spark.createDataFrame([(k,) for k in sorted(kinds.value)], "event_type string")


@query("side_file_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t: Tables):
    path = scratch_path(t.spark, "side-file")
    line = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    t.nation.coalesce(1).select(line.alias("value")).write.text(path)
    discard_on_exit(t.spark, path)
    names = t.spark.read.format("binaryFile").load(path).select("path").first()
    shared.add_file(t.spark, names["path"])
    file_name = names["path"].rsplit("/", 1)[-1]
    customers = t.customer.select("c_custkey", "c_nationkey")
    return shared.file_lookup(customers, file_name, "c_nationkey", "n_name").drop("c_nationkey")
