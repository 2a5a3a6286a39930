"""End-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..jobs.pagerank import pagerank
from ..jobs.word_count import word_count
from .registry import Tables, query


@query(
    "word_count",
    """SELECT word, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
       GROUP BY word""",
)
def _(t: Tables):
    return word_count(t.documents, "text")


ROUNDS = 5


def _pagerank_sql() -> str:
    steps = """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem),
      d AS (SELECT s, count(*) AS deg FROM e GROUP BY s),
      r0 AS (SELECT s AS node, 1.0::DOUBLE AS rank FROM d)"""
    for i in range(1, ROUNDS + 1):
        steps += f""", r{i} AS (SELECT t AS node, 0.15 + 0.85 * sum(rank / deg) AS rank
          FROM e JOIN d USING (s) JOIN r{i - 1} ON node = e.s GROUP BY t)"""
    return steps + f" SELECT node, round(rank, 8) AS rank FROM r{ROUNDS}"


@query("pagerank", _pagerank_sql())
def _(t: Tables):
    """Supplier and part numbers share one id space, so parts pass on rank as well."""
    edges = t.lineitem.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return pagerank(edges, ROUNDS).select("node", F.round("rank", 8).alias("rank"))
