"""SimHash and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import groups, simhash
from keyloom.llm.components import components


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def documents(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = [None, "", " \t", "One two", "one TWO", "a b c d", "É é İ ẞ words"]
    long = [r.choice(words) for _ in range(3000)]
    for _ in range(40):
        texts.append(" ".join(r.choices(words, k=r.randint(5, 60))))
    for _ in range(120):  # a dense group of near copies, chains included
        long = list(long)
        long[r.randrange(len(long))] = r.choice(words)
        texts.append(" ".join(long))
    texts += texts[-5:] + [texts[7]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One two"), (None, texts[9]), (None, "lonely text without id")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(spark, block, monkeypatch):
    real = groups.compare
    monkeypatch.setattr(groups, "compare", lambda *a, **k: real(*a, **{**k, "block": block}))
    df, rows = documents(spark)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df.withColumn("fp", F.lit("clash"))).collect()), key=repr)
    prints = [fingerprint(t) for _, t in rows]
    root = reach(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = [(i, p - (1 << 64) if p >> 63 else p, least.get(root[p])) for (i, _), p in zip(rows, prints)]
    assert got == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(set(prints))
    kept = simhash.deduplicate(df)
    left = {(i, t) for (i, t), w in zip(rows, want) if i is None or i == w[2]}
    assert {tuple(r) for r in kept.collect()} == left
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 200)] + [(r.randint(300, 500), r.randint(300, 500)) for _ in range(150)]
    links += [(7, 7), (1000, 900), (900, 1000), (None, 5)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    got = {x.node: x.root for x in found.collect()}
    pairs = {(a, b) for a, b in links if a is not None and a != b}
    nodes = sorted({n for p in pairs for n in p})
    assert got == reach(nodes, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert found.count() == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
