"""Packing and merge-dropout against the tokenizers themselves."""

import math
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from keyloom.llm import merge_dropout, packing

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Don't STOP... it's \"quoted,\" they'll.,!? a.b,c x…, é, 12,345.6 dogs'. x'."),
    (4, "Don't STOP... it's"),
    (None, "a <|endoftext|> b<|STARTOFTEXT|> c"),
    (5, "tabs\tand hard spaces\x1c\x85 ▁literal ▁▁ two  three   \n\n  lines \r\n"),
    (6, "İstanbul straße ﬁ ① é \U0001f600​ 中文 \U00020000"),
    (7, "x" * 70000),
    (8, "word%d " * 9000 % tuple(range(9000))),
]


@pytest.fixture(scope="module")
def documents(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return given.union(odd).withColumns({"ids": F.lit("clash"), "start": F.lit(1)})


@pytest.mark.parametrize("capacity,block", [(4096, 1 << 20), (4096, 3000), (50, 1000)])
def test_packing(documents, capacity, block):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for r in documents.select("doc_id", "text").collect():
        want[r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)] += 1
    pieces = packing.pack(documents, capacity=capacity, block=block).collect()
    by, total = defaultdict(list), 0
    for p in pieces:
        by[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length and p.length > 0
        total += p.length
    for rows in by.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    # rebuild the documents from consecutive pieces
    got, open_ids = defaultdict(int), None
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        if p.start == 0:
            assert open_ids is None
            open_ids = ()
        assert len(open_ids) == p.start
        open_ids += tuple(array("I", p.ids))
        if len(open_ids) == p.doc_tokens:
            got[p.doc_id, open_ids] += 1
            open_ids = None
    assert open_ids is None and got == want
    if capacity == 4096 and block > 4096:
        parts = documents.rdd.getNumPartitions()
        assert len(by) * capacity - total < 0.01 * total + parts * capacity


def test_packing_is_optimal():
    import random

    r = random.Random(3)
    for _ in range(60):
        at = [0]
        for _ in range(r.randint(1, 12)):
            at.append(at[-1] + r.randint(1, 10))
        penalty = [0] + [r.choice([0, 2, 5]) for _ in at[1:]]

        def least(i):
            if i == 0:
                return 0
            return min(least(j) + 10 + penalty[i] for j in range(i) if at[i] - at[j] <= 10)

        cuts = packing.best_cuts(at, penalty, 10, True)
        spans = zip([0, *cuts], cuts)
        assert cuts[-1] == len(at) - 1 and all(at[b] - at[a] <= 10 for a, b in spans)
        assert len(cuts) * 10 + sum(penalty[c] for c in cuts) == least(len(at) - 1)


def test_packing_empty(documents):
    assert packing.pack(documents.limit(0)).count() == 0


def test_plain_merges_are_the_model_s(documents):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = merge_dropout.loaded(None)
    for r in documents.select("text").collect():
        text = (r[0] or "").replace("▁", "")
        assert list(array("I", pieces.encode(text, 0.0, 1, 0))) == model.encode(text)


def test_dropout(documents):
    encoded = merge_dropout.encode(documents, ["doc_id", "text"]).collect()
    plain = merge_dropout.encode(documents, ["doc_id", "text"], dropout=0.0).collect()
    other = merge_dropout.encode(documents, ["doc_id", "text"], seed=7).collect()
    again = merge_dropout.encode(documents.repartition(3), ["doc_id", "text"]).collect()
    assert sorted(map(repr, encoded)) == sorted(map(repr, again))
    size = lambda rows: sum(len(r.ids) for r in rows)
    assert size(plain) * 1.02 < size(encoded) < size(plain) * 2
    assert sum(a.ids != b.ids for a, b in zip(encoded, other)) > 150
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in encoded:
        assert model.decode(list(array("I", r.ids))) == (r.text or "")
    back = merge_dropout.decode(merge_dropout.encode(documents, ["doc_id", "text"]).withColumnRenamed("text", "given"), ["given"])
    assert back.filter(F.coalesce("given", F.lit("")) != F.col("text")).count() == 0
    assert back.count() == documents.count()


def plain_agenda(pieces, symbols, skip):
    """The agenda as a list of one candidate per neighbour; ``skip`` says of each candidate whether it is skipped."""
    none = (float("inf"), -1)
    rank = lambda i: pieces.rank.get(symbols[i] + symbols[i + 1], none)
    agenda, place = [rank(i) for i in range(len(symbols) - 1)], list(range(len(symbols)))
    while agenda and min(agenda) != none:
        i = agenda.index(min(agenda))
        if skip(agenda[i][1], place[i]):
            agenda[i] = none
            continue
        symbols[i] += symbols.pop(i + 1)
        del place[i + 1], agenda[i]
        for k in (i - 1, i):
            if 0 <= k < len(agenda):
                agenda[k] = rank(k)
    return symbols


def keyed(pieces, symbols, limit, key):
    return plain_agenda(pieces, symbols, lambda piece, left: limit > 0 and pieces.skipped(piece, left, limit, key))


def symbols_of(unit):
    return [merge_dropout.SPACE if c == " " else merge_dropout.LITERAL if c == "▁" else c for c in unit]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_ids_by_plain_agenda(documents, dropout):
    """Id for id what the agenda gives that takes one candidate of one unit after the other."""
    pieces = merge_dropout.loaded(None)

    def gap(draw):
        return 0 if dropout >= 1 else int(math.log(max(draw, 1e-300)) / math.log1p(-dropout)) if dropout > 0 else 1 << 62

    for r in merge_dropout.encode(documents, ["doc_id", "text"], dropout=dropout, seed=9, id_col="doc_id").withColumn(
        "document", F.xxhash64(F.coalesce("text", F.lit("")), "doc_id")
    ).collect():
        key = xxhash.xxh64_intdigest(b"%d,%d" % (9, r.document))
        units = pieces.cut.findall(" " + r.text) if r.text else []
        draws = np.random.Generator(np.random.Philox(key=key)).random(len(units))
        want = []
        for place, unit in enumerate(units):
            state = [gap(draws[place]), 0]

            def skip(piece, left):
                state[0] -= 1
                if state[0] >= 0:
                    return False
                state[1] += 1
                state[0] = gap(xxhash.xxh64_intdigest(b"%d,%d" % (place, state[1]), key) / 2**64)
                return True

            for part in pieces.parts(unit):
                if len(part) > merge_dropout.SHORT:
                    own = xxhash.xxh64_intdigest(b"%d" % place, key)
                    merged = pieces.merge_long(symbols_of(part), int(dropout * 2**64), own)
                else:
                    merged = plain_agenda(pieces, symbols_of(part), skip)
                for s in merged:
                    text = "▁" if s == merge_dropout.LITERAL else s
                    want += [pieces.rank[s][1]] if s in pieces.rank else [pieces.bytes[b] for b in text.encode()]
        assert list(array("I", r.ids)) == want


def test_both_agendas_agree():
    import random

    pieces, r = merge_dropout.loaded(None), random.Random(2)
    for _ in range(400):
        unit = "".join(r.choices(" abcdehinorst▁é", k=r.randint(1, 90)))
        key, limit = r.getrandbits(64), r.choice([0, 2**62, 2**63])
        assert keyed(pieces, symbols_of(unit), limit, key) == pieces.merge_long(symbols_of(unit), limit, key)


def test_units_are_varied():
    pieces = merge_dropout.loaded(None)
    seen = {pieces.encode("international understanding", 0.3, 42, v) for v in range(32)}
    assert len(seen) > 8


def test_occurrences_are_varied(spark):
    """Each occurrence is segmented anew, at the rates of a brute-force version that draws every skip."""
    import random
    from collections import Counter

    pieces, word = merge_dropout.loaded(None), " understanding"
    size = lambda text, d: len(pieces.encode(text, 0.1, 42, d)) // 4
    assert len({pieces.encode(word[1:], 0.3, 42, d) for d in range(1000)}) > 30
    # what a longer text has more than a shorter one is its last word
    sizes = Counter(size((word * n)[1:], 1) - size((word * (n - 1))[1:], 1) for n in range(2, 400))
    assert len(sizes) > 2
    r, brute, n = random.Random(1), Counter(), 4000
    for _ in range(n):
        brute[len(keyed(pieces, symbols_of(word), 2**64 // 10, r.getrandbits(64)))] += 1
    got = Counter(size(word[1:], d) for d in range(n))
    assert all(abs(got[k] - brute[k]) < 5 * (brute[k] + 9) ** 0.5 for k in brute | got)
    docs = spark.createDataFrame([(i, "understanding") for i in range(200)], "doc_id long, text string")
    assert len({bytes(x.ids) for x in merge_dropout.encode(docs, ["doc_id"], id_col="doc_id").collect()}) > 4


def test_dropout_empty(documents):
    assert merge_dropout.encode(documents.limit(0), ["doc_id"]).count() == 0


def test_repeated_skips_are_merged_once(monkeypatch):
    """What units become after the same skips is kept, in a table that starts anew beyond its bound, and the ids stay."""
    pieces, merged = merge_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model")), []
    text = "understanding, the other thing " * 4000
    inner = pieces.merge_many

    def counted(parts, *rest):
        merged.append(len(parts))
        return inner(parts, *rest)

    monkeypatch.setattr(pieces, "merge_many", counted)
    first = pieces.encode(text, 0.1, 42, 1)
    assert sum(merged) < 4000  # more than 8000 of the 16000 units skip a candidate
    monkeypatch.setattr(merge_dropout, "NODES", 1)
    monkeypatch.setattr(merge_dropout, "DEPTH", 0)
    assert pieces.encode(text, 0.1, 42, 1) == first
    assert sum(merged) > 4000


def test_dropout_hands_over_small_batches(spark):
    import pyarrow as pa

    pieces = merge_dropout.loaded(None)
    runs = list(pieces.in_runs(pa.array(["word " * 50_000] * 8), 0.1, 42, list(range(8))))
    assert [len(ids) for ids in runs[:2]] == [3, 3] and sum(map(len, runs)) == 8
    # what decodes needs no table of merges
    assert not hasattr(merge_dropout.loaded(None, merge_dropout.Spelled), "neighbours")


def test_units_are_cut_in_arrays():
    """Units and tails as the pattern and ``parts`` give them, text by text."""
    import random

    from keyloom.llm import words

    pieces, r = merge_dropout.loaded(None), random.Random(4)
    alphabet = list("ab  \n.,!?;:%$*&#|▁é中\U0001f600\t\r\0'1")
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 20))) for _ in range(3000)]
    texts += [f"{chr(p[0])}{chr(p[1])} " for p in ((ord(a), ord(b)) for a, b in pieces.pairs if b in merge_dropout.TAIL)]
    spaced = [(" " + t).encode() for t in texts]
    starts, cores, stops = pieces.units(words.padded(b"".join(spaced)), np.cumsum([0, *map(len, spaced)]))
    raw = b"".join(spaced)
    got = [[raw[a:b].decode(), *([raw[b:c].decode()] if b < c else [])] for a, b, c in zip(starts, cores, stops)]
    assert got == [pieces.parts(u) for t in texts for u in pieces.cut.findall(" " + t)]


def test_many_units_are_merged_once():
    """More units than a worker kept before are not merged anew when they come again."""
    pieces, merged = merge_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model")), []
    inner = pieces.merge_many
    pieces.merge_many = lambda parts, *rest: merged.append(len(parts)) or inner(parts, *rest)
    letters = "abcdefghijklmnop"
    text = " ".join(a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in letters[:5])
    first = pieces.encode(text, 0.0, 42, 1)
    n = len(merged)
    assert pieces.encode("b " + text, 0.0, 42, 2) and sum(merged[n:]) < 10
    assert pieces.encode(text, 0.0, 42, 1) == first
