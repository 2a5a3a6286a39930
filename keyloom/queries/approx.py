"""Approximate aggregates. Estimates are followed over all parts of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import confidence_factor
from ..operators import approx
from ..plans.shared import materialise
from .registry import Tables, query

PARTS = 8
_Z = "1.959963984540054"  # normal quantile of 0.975


@query(
    "approx_distinct",
    "SELECT count(DISTINCT l_partkey) AS exact, true AS loose_ok, true AS tight_ok FROM lineitem",
)
def _(t: Tables):
    loose = approx.approx_distinct_column("l_partkey", relative_sd=0.05)
    tight = approx.approx_distinct_column("l_partkey", p=14)
    return t.lineitem.agg(
        F.count_distinct("l_partkey").alias("exact"), loose.alias("loose"), tight.alias("tight")
    ).select(
        "exact",
        (F.abs(F.col("loose") - F.col("exact")) <= 0.2 * F.col("exact")).alias("loose_ok"),
        (F.abs(F.col("tight") - F.col("exact")) <= 0.05 * F.col("exact")).alias("tight_ok"),
    )


@query(
    "approx_distinct_by_key",
    "SELECT l_returnflag, true AS ok FROM lineitem GROUP BY l_returnflag",
)
def _(t: Tables):
    estimates = approx.count_approx_distinct_by_key(t.lineitem, "l_returnflag", "l_suppkey")
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("exact"))
    off = F.abs(F.col("distinct") - F.col("exact"))
    return estimates.join(exact, "l_returnflag").select(
        "l_returnflag", (off <= 0.2 * F.col("exact")).alias("ok")
    )


def _sql(what: str, column: str | None, key: str | None) -> str:
    g, group = (f"{key} AS g, ", "g, ") if key else ("", "")
    x = column or "1"
    base = f"""WITH s AS (SELECT {g}m AS merged, count(*) AS n, avg({x}) AS mu, var_samp({x}) AS v
      FROM lineitem JOIN (SELECT unnest(generate_series(1, {PARTS})) AS m) ON l_orderkey % {PARTS} < m
      GROUP BY {group}m),
    e AS (SELECT *, merged / {PARTS}.0 AS p FROM s),
    c AS (SELECT *, (n + 1 - p) / p AS cm, (n + 1) * (1 - p) / (p * p) AS cv, v / n AS mv FROM e),
    """
    estimate, spread, exact = {
        "count": ("cm", "sqrt(cv)", "n"),
        "mean": ("mu", "sqrt(mv)", "mu"),
        "sum": ("mu * cm", "sqrt(mu * mu * cv + cm * cm * mv + mv * cv)", "mu * n"),
    }[what]
    names = f"g AS {key}, " if key else ""
    return base + f"""f AS (SELECT *, {estimate} AS est, {_Z} * {spread} AS half, {exact} AS ex FROM c)
    SELECT {names}CAST(merged AS INTEGER) AS merged,
      round(CASE WHEN merged = {PARTS} THEN ex ELSE est END, 3) AS mean,
      CASE WHEN merged = {PARTS} THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
      round(CASE WHEN merged = {PARTS} THEN ex ELSE est - half END, 3) AS low,
      round(CASE WHEN merged = {PARTS} THEN ex ELSE est + half END, 3) AS high FROM f"""


def _progress(t: Tables, what: str, column: str | None, by: str | None):
    part = F.col("l_orderkey") % PARTS
    out = approx.estimate_progress(t.lineitem, part, PARTS, column, by, what)
    fields = [F.round(F.col("estimate")[f], 3).alias(f) for f in ("mean", "low", "high")]
    keys = [by] if by else []
    return out.select(*keys, "merged", *fields, F.col("estimate")["confidence"].alias("confidence"))


for _name, _what, _column, _by in (
    ("count_approx_partial", "count", None, None),
    ("sum_approx_partial", "sum", "l_quantity", None),
    ("mean_approx_partial", "mean", "l_quantity", None),
    ("count_by_key_approx", "count", None, "l_returnflag"),
    ("grouped_sum_approx", "sum", "l_quantity", "l_returnflag"),
    ("grouped_mean_approx", "mean", "l_quantity", "l_returnflag"),
):
    query(_name, _sql(_what, _column, _by))(
        lambda t, what=_what, column=_column, by=_by: _progress(t, what, column, by)
    )


def _small_sql(column: str, digits: int) -> str:
    """Means of groups of any size: Student's t by the number of values, beyond 100 the normal quantile."""
    t = ", ".join(["NULL", *(repr(confidence_factor(0.95, n)) for n in range(2, 101)), _Z])
    return f"""WITH s AS (SELECT s_nationkey, m AS merged, count(*) AS n, avg({column}) AS mu, var_samp({column}) AS v
      FROM supplier JOIN (SELECT unnest(generate_series(1, {PARTS})) AS m) ON s_suppkey % {PARTS} < m GROUP BY 1, 2),
    h AS (SELECT *, [{t}][least(n, 101)] * sqrt(v / n) AS half FROM s)
    SELECT s_nationkey, CAST(merged AS INTEGER) AS merged, round(mu, {digits}) AS mean,
      round(CASE WHEN merged = {PARTS} THEN mu WHEN n > 1 THEN mu - half END, {digits}) AS low,
      round(CASE WHEN merged = {PARTS} THEN mu WHEN n > 1 THEN mu + half END, {digits}) AS high FROM h"""


def _small_groups(t: Tables, shift: float, digits: int):
    suppliers = t.supplier.select("s_nationkey", "s_suppkey", (F.col("s_acctbal") + shift).alias("x"))
    out = approx.estimate_progress(suppliers, F.col("s_suppkey") % PARTS, PARTS, "x", "s_nationkey", "mean")
    # one value has no spread: its bounds are unknown, whatever number stands for that
    known = {f: F.col("estimate")[f] for f in ("low", "high")}
    bounds = [F.when(~F.isnan(e) & (F.abs(e) < float("inf")), F.round(e, digits)).alias(f) for f, e in known.items()]
    return out.select("s_nationkey", "merged", F.round(F.col("estimate")["mean"], digits).alias("mean"), *bounds)


# more digits than a mean of a few cents has, so that none ends in a half
query("mean_approx_small_groups", _small_sql("s_acctbal", 6))(lambda t: _small_groups(t, 0.0, 6))
query("mean_approx_shifted", _small_sql("(s_acctbal + 1e9)", 3))(lambda t: _small_groups(t, 1e9, 3))


@query(
    "distinct_sketch_union",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS same, true AS close
       FROM lineitem GROUP BY l_returnflag""",
)
def _(t: Tables):
    """Stored sketches of eight parts, united by key, say what a sketch of the whole says."""
    part = (F.col("l_orderkey") % PARTS).alias("part")
    lines = t.lineitem.select("l_returnflag", "l_partkey", part)
    parts = materialise(approx.distinct_sketches(lines, ["part", "l_returnflag"], "l_partkey"), "sketches")
    united = approx.distinct_of(approx.unite_sketches(parts, "l_returnflag"), "united")
    # uniting changes the estimator, so the whole is united as well: with parts that add nothing
    whole = approx.distinct_sketches(lines, "l_returnflag", "l_partkey").unionByName(parts.drop("part"))
    whole = approx.unite_sketches(whole, "l_returnflag")
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    off = F.abs(F.col("united") - F.col("exact"))
    return united.join(approx.distinct_of(whole, "whole"), "l_returnflag").join(exact, "l_returnflag").select(
        "l_returnflag", "exact", (F.col("united") == F.col("whole")).alias("same"),
        (off <= 4 * 1.04 / 64 * F.col("exact")).alias("close"),  # four deviations of 2^12 registers
    )
