"""Near copies at a shingle similarity of 0.8 against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import groups, near_copies

from .test_simhash import reach


def shingles(text, n=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components(rows):
    """Smallest id reachable, by all pairs of texts; rows that share an id hang together."""
    sets = [shingles(t) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    linked = {(i, j) for i, a in zip((r[0] for r in rows), sets) for j, b in zip((r[0] for r in rows), sets) if i is not None and j is not None and similar(a, b)}
    return reach(ids, lambda a, b: (a, b) in linked)


def edited(r, words, share):
    """The words with single ones replaced, five shingles apart, so that about ``share`` of the shingles stay common."""
    words = list(words)
    # k replaced words change 5k shingles on each side: (n - 5k) / (n + 5k) stays
    k = int(len(words) * (1 - share) / (1 + share) / 5)
    for at in r.sample(range(0, len(words) - 4, 6), k):
        words[at + 2] = f"new{r.randrange(10**9)}"
    return words


def documents():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [None, "", " \t", "One two", "one TWO", "a b c d", "É é İ ẞ words"]
    for _ in range(60):
        texts.append(" ".join(r.choices(vocabulary, k=r.randint(5, 80))))
    base = r.choices(vocabulary, k=400)
    for _ in range(60):  # copies of one text, and a chain whose ends are not similar
        texts.append(" ".join(edited(r, base, 0.93)))
    for _ in range(30):
        base = edited(r, base, 0.88)
        texts.append(" ".join(base))
    passage = " ".join(r.choices(vocabulary, k=60))  # one passage, repeated: few distinct shingles are common
    texts += [passage + " " + passage + " " + " ".join(r.choices(vocabulary, k=60)) for _ in range(5)]
    texts.append(" ".join(r.choices(vocabulary, k=30000)))
    texts.append(" ".join(edited(r, texts[-1].split(), 0.85)))
    texts += texts[-4:] + [texts[7]]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "One two"), (8, texts[20]), (None, texts[9]), (None, "lonely text")]


@pytest.mark.parametrize("block", [near_copies.BLOCK, 64])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(rows)
    got = near_copies.near_copies(df).collect()
    assert len(got) == sum(i is not None for i, _ in rows)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = near_copies.deduplicate(df.withColumn("size", F.lit("x")).withColumn("node", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "size", "node"]
    assert sorted(r.doc_id for r in kept.select("doc_id").distinct().collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.filter("doc_id is null").count() == 2


@pytest.mark.parametrize(("share", "least"), [(0.8, 0.9), (0.85, 0.97), (0.9, 0.99), (0.95, 1.0)])
def test_recall(spark, share, least):
    r = random.Random(int(share * 100))
    rows = []
    for i in range(200):
        words = r.choices([f"w{j}" for j in range(5000)], k=r.randint(150, 900))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(r, words, share)))]
    pairs = {i for i in range(200) if similar(shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1]))}
    assert len(pairs) > 180
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id // 2: x.component_id for x in near_copies.near_copies(df).filter("doc_id % 2 = 1").collect()}
    hits = {i for i, root in found.items() if root == 2 * i}
    assert hits <= pairs and len(hits) >= least * len(pairs)
    assert all(root in (2 * i, 2 * i + 1) for i, root in found.items())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.near_copies(none).count() == 0 and near_copies.deduplicate(none).count() == 0


def test_shingles():
    text = "A b c d e f g a b c d e"
    assert len(near_copies.shingles(text.encode(), 5)) == len(shingles(text))
    assert len(near_copies.shingles(b"one two", 5)) == 1 and len(near_copies.shingles(b" ", 5)) == 0
    assert not np.array_equal(near_copies.shingles(b"a b c d e", 5), near_copies.shingles(b"e d c b a", 5))
