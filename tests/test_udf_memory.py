"""Groups and table functions hold little more than the values they work on."""

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from keyloom.operators import udfs


def test_group_values_are_shuffled_packed(spark):
    df = spark.range(0, 30_000, 1, 2).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "CAST(id AS double) AS v")
    packed = udfs._pack(df, ["k"], "v")
    assert packed.count() <= 3 * (2 * 2)  # keys times batches, not rows
    got = udfs.reduce_groups(df, "k", "v", lambda s: float(s.sum()), "double").collect()
    assert {r["k"]: r["v"] for r in got} == {k: float(sum(range(k or 0, 30_000, 3))) for k in (None, 1, 2)}


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "float", "double"])
def test_packed_numbers_look_like_whole_ones(spark, kind):
    df = spark.createDataFrame(
        [("a", 1, 5), ("a", 1, None), ("a", 2, 3), ("b", None, None), ("b", None, 4), ("c", None, 9), (None, 1, 2)],
        "s string, k int, v int",
    ).selectExpr("s", "k", f"CAST(v AS {kind}) AS v")

    def shape(v: pd.Series) -> str:
        return f"{v.dtype} {len(v)} {v.isna().sum()} {sorted(v.dropna())}"

    def plain(v: pd.Series) -> str:
        return shape(v)

    reducer = udfs.F.pandas_udf(plain, "string", udfs.F.PandasUDFType.GROUPED_AGG)
    want = df.repartition(3).groupBy("s", "k").agg(reducer("v").alias("v")).collect()
    got = udfs.reduce_groups(df.repartition(3), ["s", "k"], "v", shape, "string").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_table_function_gets_bounded_slices(spark):
    def split(texts):
        if texts.nbytes > 2 * udfs.SLICE_BYTES and len(texts) > 1:
            raise ValueError("too much at once")
        lists = pc.split_pattern(texts, " ")
        return pc.list_parent_indices(lists), [pc.list_flatten(lists)]

    df = spark.range(0, 3000, 1, 1).selectExpr("id", "IF(id % 7 = 0, NULL, repeat('ab cd ', 500)) AS s")
    got = udfs.table_function_batches(df, split, "s", "w string", ["id"])
    whole = 3000 - 429
    assert got.groupBy("w").count().collect() and got.count() == whole * 1001
    assert sum(b.num_rows for b in udfs._slices(pa.record_batch({"s": ["x" * 1000] * 5000}), 0)) == 5000
