"""The Merkle manifest against a plain tree, and multiproofs against the definition of what they need."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import merkle
from keyloom.llm.queries import ORACLES, QUERIES
from tools import check

FOLDER = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level, position):
    """Root of a list of digests and the steps of one of them."""
    steps = []
    while len(level) > 1:
        run = level[position // 8 * 8 :][:8]
        k = position % 8
        steps.append(("".join(run[:k]), "".join(run[k + 1 :])))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        position //= 8
    return level[0], steps


def plain(rows):
    """rows: (value, order, digest). (value, order, digest, subroot, root, steps) of each."""
    trees = {}
    for v, o, d in rows:
        trees.setdefault(v, []).append((o is not None, o, d))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: sorted(t, key=lambda x: (x[0], x[1] or 0, x[2])) for v, t in trees.items()}
    subroots = [climb([d for *_, d in trees[v]], 0)[0] for v in names]
    found = []
    for i, v in enumerate(names):
        root, more = climb(subroots, i)
        digests = [d for *_, d in trees[v]]
        for p, (_, o, d) in enumerate(trees[v]):
            subroot, steps = climb(digests, p)
            found.append((v, o, d, subroot, root, steps + more))
    return found


ROWS = (
    [("en", i, h(str(i))) for i in range(300)]
    + [(None, None, h("x")), (None, None, h("x")), (None, 3, h("y")), ("", 1, h("e"))]
    + [("é%d" % i, 5, h("lone")) for i in range(70)]
    + [("z", 7, h("same"))] * 20
)


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    rows = ROWS[:]
    random.Random(4).shuffle(rows)
    given = [(*r, 1, "clash") for r in rows]
    leaves = spark.createDataFrame(given, "lang string, doc_id long, digest string, pos int, tree string").repartition(7)
    proofs = merkle.manifest(leaves, "lang", "doc_id", "digest").proofs()
    assert proofs.columns == ["lang", "doc_id", "pos", "tree", "leaf", "subroot", "root", "steps"]
    folded = proofs.withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps")))
    got = [
        (r.lang, r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps], r.folded, r.tree) for r in folded.collect()
    ]
    want = [(*r, r[4], "clash") for r in plain(rows)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_many_blocks(spark):
    """More than a block: a third round of nodes is not needed, a second is."""
    n = merkle.BLOCK * 9 + 5
    leaves = spark.range(n).select(F.lit("a").alias("lang"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    m = merkle.manifest(leaves, "lang", "id", "digest")
    root, _ = climb([h(str(i)) for i in range(n)], 0)
    proofs = m.proofs()
    bad = proofs.filter((merkle.fold(F.col("leaf"), F.col("steps")) != F.col("root")) | (F.col("root") != root))
    assert proofs.count() == n and bad.count() == 0
    # each leaf partition fetched only what its own leaves do not give
    assert merkle.wanted_nodes(m.trees.blocks).filter(F.col("level") < merkle.LEVELS).count() == 0


def test_proofs_of_a_few_leaves(spark):
    n = 5000
    leaves = spark.range(n).select(F.lit("a").alias("lang"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    m = merkle.manifest(leaves, "lang", "id", "digest")
    some = m.trees.blocks.withColumn("rows", F.filter("rows", lambda r: r["pos"] % 37 == 5))
    got = m.proofs(some).orderBy("id").collect()
    digests = [h(str(i)) for i in range(n)]
    assert [r.id for r in got] == list(range(5, n, 37))
    for r in got[::20]:
        assert (r.root, [tuple(s) for s in r.steps]) == climb(digests, r.id)


def test_missing_is_least():
    r = random.Random(1)
    for _ in range(300):
        size = r.randint(1, 700)
        some = sorted(r.sample(range(size), r.randint(1, min(size, 40))))
        got = {(level, i) for level, idx in merkle.missing(np.array(some), size) for i in idx.tolist()}
        want, n, level, own = set(), size, 0, set(some)
        while n > 1:
            for i in own:
                want |= {(level, j) for j in range(i // 8 * 8, min(i // 8 * 8 + 8, n)) if j not in own}
            own, n, level = {i // 8 for i in own}, -(-n // 8), level + 1
        assert got == want


def test_leaf(spark):
    rows = [(1, None, "é", 3, "A\nb"), (None, "", None, None, ""), (-7, "s", "en", 0, "x" * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in df.select(merkle.leaf([F.col(c) for c in df.columns])).collect()]
    assert got == [row_leaf(r) for r in rows]


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "lang string, doc_id long, digest string")
    assert merkle.manifest(empty, "lang", "doc_id", "digest").proofs().count() == 0
    with pytest.raises(ValueError, match="steps"):
        merkle.manifest(empty.withColumn("steps", F.lit(1)), "lang", "doc_id", "digest")


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None, None, None, None), (3, "", "xx", "", 0), (3, "", "xx", "", 0), (10**12, "ÄB\u0000c" + "Q" * 99999, None, "s", 1)]
    given.union(spark.createDataFrame(odd, given.schema)).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_against_sql(spark, odd_folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_folder}/documents.parquet/*.parquet'")
    result = con.sql(ORACLES["op12_merkle_manifest"])
    names, want = result.columns, result.fetchall()
    got = QUERIES["op12_merkle_manifest"](spark, odd_folder)
    rows = [tuple(r) for r in got.collect()]
    assert check.normal(rows, got.columns) == check.normal(want, names)
    altered = [r for r in got.collect() if not r.verified]
    assert 0 < len(altered) < len(rows)
