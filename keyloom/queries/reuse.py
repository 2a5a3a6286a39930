"""Result reuse on plans and catalogs derived from orders and their lines.

An order stands for a job: a scan of its priority's file, two steps named by its status and
lines, and a second scan of its main supplier's file followed by one more step.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import discard_on_exit, scratch_path
from ..reuse import catalog as cat
from ..reuse import plans
from ..reuse.store import Pipeline, ResultStore
from .registry import Tables, query


def _jobs(t: Tables) -> DataFrame:
    # letters are compared as numbers, which hash aggregation can keep in place
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.min(F.ascii("l_returnflag")).alias("flag_code"),
        F.max(F.ascii("l_linestatus")).alias("status_code"),
        F.min("l_suppkey").alias("supp"),
        F.count(F.lit(1)).alias("n"),
    )
    return (
        t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .withColumn("flag", F.char("flag_code"))
        .withColumn("line_status", F.char("status_code"))
    )


def _nodes(t: Tables) -> DataFrame:
    def step(pos, op, fn, path):
        return F.struct(
            F.lit(pos).alias("pos"), F.lit(op).alias("op"), fn.alias("fn"),
            F.array(path).alias("inputs"),
        )

    none = F.lit("")
    steps = F.array(
        step(0, "scan", none, F.concat(F.lit("/in/"), "o_orderpriority")),
        step(1, "filter", F.col("o_orderstatus"), none),
        step(2, "map", F.col("flag"), none),
        step(3, "scan", none, F.concat(F.lit("/supplier/"), F.col("supp").cast("string"))),
        step(4, "reduce", F.col("line_status"), none),
    )
    return _jobs(t).select(
        F.col("o_orderkey").alias("job_id"), F.inline(steps)
    ).withColumn("mtimes", F.array().cast("array<bigint>"))


_NODES = """WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority, o_orderstatus, flag, ls, supp
  FROM orders JOIN (SELECT l_orderkey, min(l_returnflag) AS flag, max(l_linestatus) AS ls, min(l_suppkey) AS supp
                    FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
 nodes AS (
  SELECT job_id, 0 AS pos, 'scan' AS op, '' AS fn, '/in/' || o_orderpriority AS input FROM j UNION ALL
  SELECT job_id, 1, 'filter', o_orderstatus, '' FROM j UNION ALL
  SELECT job_id, 2, 'map', flag, '' FROM j UNION ALL
  SELECT job_id, 3, 'scan', '', '/supplier/' || supp FROM j UNION ALL
  SELECT job_id, 4, 'reduce', ls, '' FROM j),
 pairs AS (SELECT a.job_id AS job_a, b.job_id AS job_b FROM j a JOIN j b ON b.job_id = a.job_id + 1),
 same AS (SELECT job_a, job_b, a.pos AS pos_a, b.pos AS pos_b, a.op = 'scan' AS is_scan
  FROM pairs JOIN nodes a ON a.job_id = job_a
  JOIN nodes b ON b.job_id = job_b AND a.op = b.op AND a.fn = b.fn AND a.input = b.input),
 runs AS (SELECT *, pos_a - row_number() OVER (PARTITION BY job_a, job_b, pos_a - pos_b ORDER BY pos_a) AS run FROM same),
 isl AS (SELECT job_a, job_b, pos_a - pos_b AS diff, min(pos_a) FILTER (is_scan) AS begin_a, max(pos_a) AS end_a
  FROM runs GROUP BY job_a, job_b, pos_a - pos_b, run),
 best AS (SELECT *, end_a - begin_a + 1 AS matched, row_number() OVER (PARTITION BY job_a, job_b
  ORDER BY end_a - begin_a DESC, begin_a, begin_a - diff) AS i FROM isl WHERE begin_a IS NOT NULL),
 m AS (SELECT p.job_a, p.job_b, CAST(coalesce(matched, 0) AS INTEGER) AS matched,
  CAST(coalesce(begin_a, 0) AS INTEGER) AS begin_a, CAST(coalesce(end_a, 0) AS INTEGER) AS end_a,
  CAST(coalesce(begin_a - diff, 0) AS INTEGER) AS begin_b, CAST(coalesce(end_a - diff, 0) AS INTEGER) AS end_b
  FROM pairs p LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON b.job_a = p.job_a AND b.job_b = p.job_b) """


def _neighbours(t: Tables) -> DataFrame:
    """Pairs of orders with following numbers."""
    jobs = t.lineitem.select(F.col("l_orderkey").alias("job_a")).distinct()
    following = jobs.select((F.col("job_a") - 1).alias("job_a"), F.col("job_a").alias("job_b"))
    return following.join(jobs, "job_a")


@query(
    "plan_nodes",
    _NODES
    + """SELECT op, fn, count(*) AS n, CAST(sum(files) AS BIGINT) AS files FROM (
      SELECT op, fn, CASE WHEN op = 'scan' THEN 1 ELSE 0 END AS files FROM nodes UNION ALL
      SELECT * FROM (VALUES ('scan', '', 1), ('filter', 'o_totalprice > 100000', 0),
                            ('sum', 'count, sum by priority', 0)) v(op, fn, files)) GROUP BY op, fn""",
)
def _(t: Tables):
    """Steps of the derived jobs, and of a pipeline over the orders file itself."""
    files = F.size(F.filter("inputs", lambda p: p != ""))
    fields = ["op", "fn", files.alias("files")]
    every = _nodes(t).select(*fields).unionByName(_pipeline(t).nodes().select(*fields))
    return every.groupBy("op", "fn").agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files"))


def _pipeline(t: Tables) -> Pipeline:
    scan = Pipeline(t.spark, "orders-by-priority", [f"{t.folder}/orders.parquet"])
    big = scan.then("filter", lambda df: df.filter("o_totalprice > 100000"), "o_totalprice > 100000")
    return big.then(
        "sum",
        lambda df: df.groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
        ),
        "count, sum by priority",
    )


_PRIORITIES = """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
 FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority"""


@query("rewrite_equal", _PRIORITIES)
def _(t: Tables):
    """The filtered rows are stored; the whole pipeline then starts from them."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    pipeline = _pipeline(t)
    store.store(pipeline, steps=1)
    discard_on_exit(t.spark, store.root)
    return store.run(pipeline)


@query("catalog_after_store", "SELECT 1 AS steps, 1 AS n_scans, 2 AS n_nodes, CAST(1 AS BIGINT) AS reuse, true AS has_size")
def _(t: Tables):
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    pipeline = _pipeline(t)
    store.store(pipeline, steps=1)
    discard_on_exit(t.spark, store.root)
    store.run(pipeline)
    return store.catalog().select(
        "steps", "n_scans", "n_nodes", "reuse", (F.col("size_gib") > 0).alias("has_size")
    )


@query("match_plans", _NODES + "SELECT * FROM m")
def _(t: Tables):
    return plans.match_plans(_nodes(t), _neighbours(t))


@query("reuse_matrix", _NODES + "SELECT job_a, job_b, matched / 5.0::DOUBLE AS share FROM m")
def _(t: Tables):
    return plans.reuse_matrix(_nodes(t), _neighbours(t))


@query(
    "reuse_assignments",
    _NODES
    + """, sig AS (SELECT job_id, pos, op || '|' || fn || '|' || input AS s FROM nodes),
 pre AS (
  SELECT job_id, 5 AS len, string_agg(s, chr(10) ORDER BY pos) AS p FROM sig GROUP BY job_id UNION ALL
  SELECT job_id, 4, string_agg(s, chr(10) ORDER BY pos) FROM sig WHERE pos < 4 GROUP BY job_id UNION ALL
  SELECT job_id, 3, string_agg(s, chr(10) ORDER BY pos) FROM sig WHERE pos < 3 GROUP BY job_id UNION ALL
  SELECT job_id, 2, string_agg(s, chr(10) ORDER BY pos) FROM sig WHERE pos < 2 GROUP BY job_id UNION ALL
  SELECT job_id, 1, s FROM sig WHERE pos = 0 UNION ALL
  SELECT job_id, 2, string_agg(s, chr(10) ORDER BY pos) FROM sig WHERE pos >= 3 GROUP BY job_id UNION ALL
  SELECT job_id, 1, s FROM sig WHERE pos = 3),
 first AS (SELECT p, min(job_id) AS source_job FROM pre GROUP BY p),
 c AS (SELECT job_id, source_job, len, row_number() OVER (PARTITION BY job_id ORDER BY len DESC, source_job) AS i
  FROM pre JOIN first USING (p) WHERE source_job < job_id)
 SELECT job_id, source_job, len / 5.0::DOUBLE AS share FROM c WHERE i = 1""",
)
def _(t: Tables):
    order = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("seq"))
    return plans.plan_reuse(_nodes(t), order)


NOW = datetime(1998, 1, 1)

_CATALOG = """WITH c AS (SELECT o_orderkey AS id, '/store/' || o_orderkey AS path, n AS reuse,
   CAST(o_custkey AS BIGINT) AS ms, round(o_totalprice * 100) AS size_gib, CAST(supp AS INTEGER) AS n_nodes,
   1 AS n_scans, o_orderdate AS inserted
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS supp FROM lineitem GROUP BY 1)
  ON o_orderkey = l_orderkey) """


def _catalog(t: Tables) -> DataFrame:
    """Orders as stored results; sizes are whole numbers so that sums are exact."""
    return _jobs(t).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/store/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("n").alias("reuse"),
        F.col("o_custkey").alias("ms"),
        F.round(F.col("o_totalprice") * 100).alias("size_gib"),
        F.col("supp").cast("int").alias("n_nodes"),
        F.lit(1).alias("n_scans"),
        F.col("o_orderdate").alias("inserted"),
    )


@query(
    "evict_candidates",
    _CATALOG
    + """, a AS (SELECT *, epoch(TIMESTAMP '1998-01-01') - epoch(inserted) >= 604800 AS old FROM c),
  f AS (SELECT *, sum(size_gib) OVER (ORDER BY reuse, ms, size_gib, n_nodes, n_scans, path) - size_gib AS freed
        FROM a WHERE NOT old),
  l AS (SELECT (SELECT sum(size_gib) FROM a WHERE NOT old) AS fresh, (SELECT sum(size_gib) FROM a WHERE NOT old) / 2 AS cap)
  SELECT id, path, 'age' AS reason FROM a WHERE old UNION ALL
  SELECT id, path, 'rank' FROM f, l WHERE freed < fresh + cap / 4 - cap""",
)
def _(t: Tables):
    """The store may keep half of its recent results and needs room for an eighth."""
    catalog = _catalog(t)
    limit = F.lit((NOW - timedelta(days=cat.MAX_AGE_DAYS)).isoformat(sep=" ")).cast("timestamp_ntz")
    fresh = catalog.filter(F.col("inserted") > limit).agg(F.sum("size_gib")).first()[0]
    return cat.evict_candidates(catalog, fresh / 2, fresh / 8, NOW)


@query(
    "stale_entries",
    """SELECT DISTINCT l_orderkey AS id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
       WHERE p_partkey IS NULL OR p_size <> 25""",
)
def _(t: Tables):
    """An order stands for an entry, its parts for the input files it read when they had size 25."""
    stored = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("path"), F.lit(25).cast("long").alias("mtime")
    )
    current = t.part.select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("mtime"))
    return cat.stale_entries(stored, current)


def _dear_lines(t: Tables, name: str) -> DataFrame:
    """A join of two filtered tables, built anew for each use."""
    orders = t.orders.filter("o_totalprice > 100000").alias(name)
    lines = t.lineitem.filter(F.col("l_quantity") > 10)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


_DEAR = """FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 WHERE o_totalprice > 100000 AND l_quantity > 10"""


@query(
    "plan_tree_reuse",
    f"""SELECT o_orderpriority, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers,
     CAST(1 AS BIGINT) AS hits {_DEAR} GROUP BY o_orderpriority""",
)
def _(t: Tables):
    """The join is stored once; an equal one, built elsewhere below a sum, starts from the store."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    store.store_frame(_dear_lines(t, "a"))
    discard_on_exit(t.spark, store.root)
    summed = (
        _dear_lines(t, "b").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("numbers"))
    )
    result = store.run_frame(summed)
    hits = store.catalog().agg(F.sum("reuse").alias("hits"))
    return result.crossJoin(F.broadcast(hits))  # one row


@query(
    "plan_tree_two_parts",
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
       b AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0)
       SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS orders, CAST(2 AS BIGINT) AS hits
       FROM a JOIN b ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t: Tables):
    """Two stored parts meet in a join that was never stored."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))

    def counts():
        return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    def rich():
        return t.customer.filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")

    store.store_frame(counts())
    store.store_frame(rich())
    discard_on_exit(t.spark, store.root)
    both = counts().join(rich(), F.col("o_custkey") == F.col("c_custkey"))
    result = store.run_frame(both.groupBy("c_mktsegment").agg(F.sum("n").alias("orders")))
    return result.crossJoin(F.broadcast(store.catalog().agg(F.sum("reuse").alias("hits"))))  # one row
