"""The pivot index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import pivots

from .test_simhash import reach


def brute(rows):
    ok = [
        e is not None and len(e) > 0 and None not in e and all(np.isfinite(e)) and any(e) for _, e in rows
    ]
    norm = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if o else None for (_, e), o in zip(rows, ok)]
    linked = lambda a, b: ok[a] and ok[b] and len(norm[a]) == len(norm[b]) and norm[a] @ norm[b] >= 0.9 - 1e-12
    n = range(len(rows))
    root = reach(list(n), linked)
    least = {}
    for i in n:
        if rows[i][0] is not None:
            least[root[i]] = min(rows[i][0], least.get(root[i], rows[i][0]))
    out = []
    for i in n:
        component = least.get(root[i]) if ok[i] else rows[i][0]
        out.append((rows[i][0], sum(linked(i, j) for j in n if j != i), component, rows[i][0] == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 9])
def test_brute_force(spark, block):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 12] + r.normal(size=16) * 0.03]) for i in range(50)]
    rows += [(200 + i, [float(x) for x in base[3] + r.normal(size=16) * 0.01]) for i in range(40)]  # a dense group
    rows += [(300, rows[3][1]), (301, rows[3][1]), (301, rows[3][1]), (302, [3 * x for x in rows[5][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None]), (404, [float("nan")] * 16)]
    rows += [(405, [float("inf")] * 16), (406, [1.0, 2.0]), (407, [1.0, 2.1]), (None, rows[7][1]), (None, [9.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "key": F.lit(1)})
    got = sorted((tuple(x) for x in pivots.near_duplicates(df, block=block).collect()), key=repr)
    want = brute(rows)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert there >= found >= 0.99 * there
    if block == 1024:
        first = got
        assert first == want
    assert pivots.near_duplicates(df.limit(0)).count() == 0
    assert pivots.near_duplicates(df.filter("vec_id = 406")).collect()[0][1] == 0


def test_recall(spark):
    """Against all pairs of a table, at the production parameters."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}
    rows = df.select("vec_id", "embedding").collect()
    x = pivots.units(np.array([r[1] for r in rows], float))
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(got.values()) >= 0.95 * want.sum()
    assert all(got[r[0]] <= w for r, w in zip(rows, want))
