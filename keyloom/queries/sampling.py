"""Sampling. What a draw picks is random; sizes, coverage and bounds are not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from .registry import Tables, query

SEED = 17


def _share_ok(sample, whole, share: float, spread: float):
    """Whether the sample's size is within six standard deviations."""
    n = whole.agg(F.count(F.lit(1)).alias("n"))
    got = sample.agg(F.count(F.lit(1)).alias("got"))
    one = F.lit(0).alias("one")
    off = F.abs(F.col("got") - F.col("n") * share)
    return (
        n.select("n", one)
        .join(F.broadcast(got.select("got", one)), "one")
        .select("n", (off <= 6 * F.sqrt(F.col("n") * spread) + 1).alias("ok"))
    )


@query("sample_bernoulli", "SELECT count(*) AS n, true AS ok FROM lineitem")
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey")
    return _share_ok(sampling.sample(lines, 0.1, SEED), lines, 0.1, 0.09)


@query("sample_poisson", "SELECT count(*) AS n, true AS ok FROM lineitem")
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey")
    return _share_ok(sampling.sample(lines, 1.5, SEED, with_replacement=True), lines, 1.5, 1.5)


@query(
    "random_split",
    "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, count(*) AS keys FROM orders",
)
def _(t: Tables):
    parts = sampling.random_split(t.orders.select("o_orderkey"), [0.5, 0.3, 0.2], SEED)
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_orderkey").alias("key_sum"),
        F.count_distinct("o_orderkey").alias("keys"),
    )


@query("take_sample", "SELECT CAST(count(*) // 4 AS BIGINT) AS n, CAST(count(*) // 4 AS BIGINT) AS keys FROM orders")
def _(t: Tables):
    orders = t.orders.select("o_orderkey")
    sample = sampling.take_sample(orders, orders.count() // 4, SEED)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"))


def _rates(t: Tables, column: str) -> dict:
    """One rate per event type; the types are few."""
    kinds = sorted(r[0] for r in t.events.select(column).distinct().toLocalIterator())
    return {k: round(0.1 + 0.05 * i, 2) for i, k in enumerate(kinds)}


@query("sample_by_key", "SELECT event_type, true AS ok FROM events GROUP BY event_type")
def _(t: Tables):
    rates = _rates(t, "event_type")
    events = t.events.select("event_type", "event_id")
    sample = sampling.sample_by_key(events, "event_type", rates, SEED)
    got = sample.groupBy("event_type").agg(F.count(F.lit(1)).alias("got"))
    n = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    off = F.abs(F.col("got") - F.col("n") * table[F.col("event_type")])
    return n.join(got, "event_type").select("event_type", (off <= 6 * F.sqrt("n")).alias("ok"))


_EXACT = """WITH k AS (SELECT event_type, count(*) AS n,
 row_number() OVER (ORDER BY event_type) - 1 AS i FROM events GROUP BY event_type)
 SELECT event_type, CAST(ceil(n * round(0.1::DOUBLE + 0.05::DOUBLE * i, 2)) AS BIGINT) AS n FROM k"""


@query("sample_by_key_exact", _EXACT)
def _(t: Tables):
    events = t.events.select("event_type", "event_id")
    sample = sampling.sample_by_key_exact(events, "event_type", _rates(t, "event_type"), SEED)
    return sample.groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))


@query("reservoir_per_partition", "SELECT count(*) AS n, true AS ok FROM events")
def _(t: Tables):
    kept = sampling.reservoir_per_partition(t.events.select("event_id"), 5, SEED)
    per = kept.groupBy("partition").agg(
        F.max("partition_rows").alias("n"), F.count_distinct("event_id").alias("kept")
    )
    return per.agg(
        F.sum("n").alias("n"), F.bool_and(F.col("kept") == F.least("n", F.lit(5))).alias("ok")
    )


@query("cell_sample", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events")
def _(t: Tables):
    inside, outside = sampling.cell_sample(t.events.select("event_id"), 0.2, 0.5, SEED)
    both = inside.unionByName(outside)
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
