"""Every stage of the pipeline against a brute-force version, each on what its predecessor kept."""

from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm import neighbour_vote

from . import test_native as native
from .test_near_copies import components

FOLDER = "/root/testdata/sf0.001"


def without_repeats(texts, length=200):
    seen = {}
    for raw in texts:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in texts:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(raw, gone) if not g))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        after = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out.collect()]
        results.append((before, after))
        docs = spark.createDataFrame(after, docs.schema)
    (start, scored), (_, ruled), (_, single), (_, cut) = results

    good = neighbour_vote.fit(spark.createDataFrame(start, docs.schema), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    keep = [s >= 0.3 for s in good.scores(neighbour_vote.terms([r[1].encode() for r in start]))]
    assert sorted(scored) == sorted(r for r, k in zip(start, keep) if k) and len(scored) < len(start)

    lines = sorted({native.normal(x) for r in scored for x in r[1].split("\n") if native.words(x)})
    native.HASH.update({r[0]: r[1] for r in spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.xxhash64("x")).collect()})
    frequent, want = native.frequent(scored, 10, 0.005), []
    for i, text, lang, source, n in scored:
        b = native.base(text)
        here = [x for x in text.split("\n") if native.words(x) and (source, native.normal(x)) in frequent]
        gone = sum(len(native.words(x)) for x in here)
        poor = gone > 0 and (b[0] - gone < 20 or b[0] - gone < b[0] * 0.4)
        if b[0] >= 20 and b[4] * 100 <= b[0] * 30 and not poor:
            left = "\n".join(x for x in text.split("\n") if x not in here) if gone else text
            want.append((i, left, lang, source, len(left)))
    assert sorted(ruled) == sorted(want)

    first = components([(r[0], r[1]) for r in ruled])
    assert sorted(single) == sorted(r for r in ruled if first[r[0]] == r[0]) and len(single) < len(ruled)

    rest = without_repeats([r[1].encode() for r in single])
    want = {r[0]: x.decode("utf-8", "ignore") for r, x in zip(single, rest)}
    assert {r[0]: r[1] for r in cut} == want and all(r[4] == len(r[1]) for r in cut)

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] = got.get(p.doc_id, ()) + tuple(array("I", p.ids))
    assert got == {i: tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (2,) for i, t in want.items()}

    whole = sorted((p.doc_id, p.start, p.length) for p in corpus_pipeline.run(spark, FOLDER).collect())
    assert {i for i, _, _ in whole} == set(want)
    assert sum(n for _, _, n in whole) == sum(map(len, got.values()))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty(spark, stage):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert stage[1](spark, docs, FOLDER).count() == 0
