"""The classifier: held-out accuracy, brute-force voting, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import neighbour_vote as vote
from keyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    got = QUERIES["op5_neighbour_vote"](spark, FOLDER)
    assert got.count() == tables[0].count()
    told = got.filter("held_out").join(tables[1], "doc_id").select("predicted", "quality").collect()
    assert len(told) > 30
    assert np.mean([r[0] == r[1] for r in told]) >= 0.95


def test_votes_are_exact(tables):
    docs, labels = tables
    model = vote.fit(docs, labels)
    rows = docs.limit(50).select("doc_id", "text").collect()
    got = {r[0]: r[1] for r in vote.score(docs.limit(50), model, ["doc_id"]).collect()}
    for i, text in rows:
        z = model.latent(vote.terms([text.encode()]))[0].astype(float)
        cosine = np.array([float(z @ v) for v in model.vectors])
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: vote.NEIGHBOURS]
        w = [max(cosine[k], 1e-6) ** vote.SHARPNESS for k in near]
        want = sum(a * model.labels[k] for a, k in zip(w, near)) / sum(w)
        assert abs(got[i] - want) < 1e-3


def test_held_out_labels_are_not_seen(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(vote.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = vote.fit(docs, labels), vote.fit(docs, flipped)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def test_bound(tables):
    assert len(vote.fit(*tables, sample=20).labels) <= 20


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "MANY!! WORDS!! " * 30000), (4, "\n \t")], "doc_id long, text string"
    ).withColumns({"score": F.lit("clash"), "label": F.lit("clash")})
    model = vote.fit(docs, labels)
    got = vote.score(odd, model, ["doc_id"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[2].score == got[3].score and got[4].score < 0.3
    assert vote.score(odd.limit(0), model, ["doc_id"]).count() == 0
    none = vote.fit(docs, labels.limit(0))
    assert [r.score for r in vote.score(odd, none, ["doc_id"]).collect()] == [0.5] * 6
    half = labels.unionByName(labels.withColumn("quality", F.lit(None).cast("int")))
    assert np.array_equal(vote.fit(docs, half).labels, model.labels)


def test_words_tell_texts_apart(spark):
    """Good and poor texts of the same letters, lengths and punctuation, which differ in the words alone."""
    r = random.Random(2)
    names = {q: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)] for q in (0, 1)}
    rows = [(i, " ".join(r.choices(names[i % 2], k=60)) + ".", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = vote.fit(df.drop("quality"), df.drop("text"))
    told = vote.score(df, model, ["doc_id", "quality"]).filter(vote.held_out("doc_id")).collect()
    assert len(told) > 50
    assert np.mean([(x.score >= 0.5) == (x.quality == 1) for x in told]) >= 0.95
