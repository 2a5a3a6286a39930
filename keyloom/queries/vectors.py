"""Vector expressions over the embeddings and their mirror images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vectors as v
from .registry import Tables, query

_BASE = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a,
 list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings),
 u AS (SELECT vec_id, label, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) - 1 AS pos FROM e) """

A = "embedding"


def _mirror() -> Column:
    return F.reverse(A)


def _elements(t: Tables, value: Column):
    return t.embeddings.select("vec_id", F.posexplode(value).alias("pos", "x")).select(
        "vec_id", "pos", F.round("x", 6).alias("x")
    )


def _elements_sql(expr: str) -> str:
    return _BASE + f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round({expr}, 6) AS x FROM u"


def _number(t: Tables, value: Column):
    return t.embeddings.select("vec_id", F.round(value, 5).alias("x"))


def _number_sql(expr: str) -> str:
    return _BASE + f"SELECT vec_id, round({expr}, 5) AS x FROM u GROUP BY vec_id"


def _add(name, value, sql, shape):
    query(name, sql)(lambda t: shape(t, value()))


_add("vector_add", lambda: v.add(A, _mirror()), _elements_sql("x + y"), _elements)
_add("vector_subtract", lambda: v.subtract(A, _mirror()), _elements_sql("x - y"), _elements)
_add(
    "vector_scale",
    lambda: v.negate(v.divide(v.multiply(A, 3.0), 4.0)),
    _elements_sql("-(x * 3.0 / 4.0)"),
    _elements,
)
_add("vector_dot", lambda: v.dot(A, _mirror()), _number_sql("sum(x * y)"), _number)
_add("vector_plus_dot", lambda: v.plus_dot(A, v.ones(F.size(F.col(A))), _mirror()), _number_sql("sum((x + 1) * y)"), _number)
_add("vector_sum", lambda: v.vector_sum(A), _number_sql("sum(x)"), _number)
_add("vector_dist", lambda: v.dist(A, _mirror()), _number_sql("sqrt(sum((x - y) * (x - y)))"), _number)
_add(
    "vector_fill",
    lambda: v.add(v.fill(F.size(F.col(A)), lambda i: i * 2), v.add(v.ones(F.size(F.col(A))), v.zeros(F.size(F.col(A))))),
    _elements_sql("CAST(pos AS DOUBLE) * 2 + 1"),
    _elements,
)


@query(
    "vector_sum_agg",
    _BASE
    + "SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(x), 5) AS x FROM u GROUP BY label, pos",
)
def _(t: Tables):
    sums = v.sum_vectors(t.embeddings, "embedding", "label")
    return sums.select("label", F.posexplode("embedding").alias("pos", "x")).select(
        "label", "pos", F.round("x", 5).alias("x")
    )
