"""Repeated 200-byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.llm import suffixes

FOLDER = "/root/testdata/sf0.001"


def brute(rows, length):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(2, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    passage = text(60)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 199), (5, "a" * 200), (6, "b" * 201), (7, "xy" * 5000)]
    rows += [(10 + i, text(r.randint(0, 50)) + passage + text(r.randint(0, 50))) for i in range(40)]
    base = text(400)
    for i in range(30):  # near copies
        at = r.randrange(len(base))
        rows.append((100 + i, base[:at] + word() + base[at + r.randint(0, 5) :]))
    rows += [(200, base), (200, base), (None, base[100:700]), (None, text(80)), (201, text(40) + passage[7:180])]
    for n in (198, 199, 200, 201, 205):  # just below and above the length, cut anywhere
        piece = "".join(r.choices("abcdefgh", k=n))
        rows += [(1000 + n, text(9) + piece + text(9)), (2000 + n, text(3) + piece), (3000 + n, piece + text(20))]
    return rows


@pytest.mark.parametrize("cover,block,parts", [(128, 4096, 1), (128, 5, 6), (16, 4096, 6)])
def test_brute_force(spark, cover, block, parts):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    df = given.union(odd).repartition(parts).withColumns({"k1": F.lit("clash"), "core": F.lit(1)})
    rows = [tuple(x) for x in df.select("doc_id", "text").collect()]
    got = suffixes.remove(df, ["doc_id"], cover=cover, block=block)
    have = sorted((tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert have == brute(rows, 200)
    assert all(len(x.kept) == x.n_bytes - x.n_removed for x in got.collect())
    assert suffixes.remove(df.limit(0), ["doc_id"]).count() == 0


def test_places_round_trip():
    import numpy as np

    p, left, right = np.array([130, 7]), np.array([3, 7]), np.array([120, 7])
    assert [x.tolist() for x in suffixes.unpack_place(suffixes.pack_place(p, left, right))] == [[130, 7], [3, 7], [120, 7]]
