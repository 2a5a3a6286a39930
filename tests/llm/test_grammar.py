"""Shards of token ids against the tokenizer itself, and the grammar against what it stands for."""

import json
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import grammar
from keyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (None, None),
    (None, "first"),
    (1, ""),
    (3, " \n\t "),
    (4, "Don't STOP... it's \"quoted,\" they'll.,!? a.b,c x…, é, 12,345.6 dogs'. x'."),
    (4, "Don't STOP... it's"),
    (4, "Don't STOP... it's"),
    (5, "a <|endoftext|> b<|ENDOFTEXT|> c <|endoftext|>"),
    (6, " lead  two   three\n\nfour\n\n\nfive \n six\n  seven\n eight trail "),
    (7, "trail\n"),
    (8, "İstanbul straße ﬁ ① é \U0001f600​ 中文 \U00020000 \x1c x\x85y 　z Ġa ĠĠ  b"),
    (9, "x" * 70000),
    (10, "ab " * 30000),
    (11, "word%d,\n" * 30000 % tuple(range(30000))),
    (12, " 's 't'll 're's"),
    (13, "\nstart\n"),
]


@pytest.fixture(scope="module")
def documents(spark):
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return known.union(odd).withColumns({"ids": F.lit("clash"), "start": F.lit(1), "first": F.lit(2), "docs": F.lit(3)})


@pytest.mark.parametrize("segment", [1 << 20, 3000])
def test_documents_come_back(spark, documents, segment):
    tokenizer = Tokenizer.from_file(PATH)
    given_rows = documents.select("doc_id", "text").collect()
    want = Counter((d, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for d, t in given_rows)
    path = grammar.write(documents.repartition(5), segment=segment)
    rows = sorted(grammar.read(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(array("I", r.ids))) for r in rows) == want
    at, order = 0, []
    for r in rows:
        assert r.start == at and 4 * r.n_tokens == len(r.ids)
        at += r.n_tokens
        order.append(-(10**18) if r.doc_id is None else r.doc_id)
    assert order == sorted(order)
    whole = np.frombuffer(b"".join(r.ids for r in rows), np.uint32)
    for a, b in [(0, 1), (0, at), (5, 5), (at // 3, at // 3 + 7000), (at - 1, at)]:
        assert (grammar.read_between(spark, path, a, b) == whole[a:b]).all()
    # rules are worth their place
    sizes = spark.read.parquet(path).select(F.explode("segments").alias("s")).select(
        F.sum(F.octet_length("s.symbols") + F.octet_length("s.rules") + F.octet_length("s.lengths")), F.sum("s.n")
    )
    stored, n = sizes.first()
    assert stored < 4 * n


ENCODER = grammar.Encoder(PATH)
TEXT = st.text(st.sampled_from(list("ab .,'\n\t1é…中\x1c\x85 　<")) | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_pieces_are_whole_texts(texts):
    ENCODER.known = {}
    encoder = ENCODER
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # learnt, then known
        assert [list(array("I", b)) for b in encoder.tokens(pa.array(texts, pa.string()))] == want


def test_generations(monkeypatch):
    monkeypatch.setattr(grammar, "KNOWN", 50)
    encoder, tokenizer = grammar.Encoder(PATH), Tokenizer.from_file(PATH)
    for i in range(30):
        texts = [f"the word{i} of, {i * k} and the." + " long" * 3 + "y" * 50 for k in range(9)]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [list(array("I", b)) for b in encoder.tokens(pa.array(texts, pa.string()))] == want
        assert len(encoder.known) < 200 and not any(len(p) > grammar.LONGEST for p in encoder.known)


def test_other_tokenizers_are_asked_for_whole_texts(tmp_path):
    shape = json.load(open(PATH))
    shape["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "lower.json")
    json.dump(shape, open(path, "w"))
    encoder, tokenizer = grammar.Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Text, OTHER text.", ""]
    assert [list(array("I", b)) for b in encoder.tokens(pa.array(texts, pa.string()))] == [tokenizer.encode(t).ids for t in texts]


def plain_length(symbol, base, rules):
    return 1 if symbol < base else sum(plain_length(s, base, rules) for s in rules[symbol - base].tolist())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(0, 600), st.integers(0, 10**6))
def test_grammar(kinds, n, seed):
    r = np.random.default_rng(seed)
    ids = r.integers(0, kinds, n).astype(np.uint32)
    rules, lengths, symbols = grammar.compress(ids, kinds)
    assert (grammar.expand(symbols, kinds, rules, lengths) == ids).all()
    assert lengths.tolist() == [plain_length(kinds + i, kinds, rules) for i in range(len(rules))]
    count = Counter(symbols.tolist()) + Counter(rules.ravel().tolist())
    assert all(count[kinds + i] for i in range(len(rules)))
    if n:
        a = int(r.integers(0, n))
        b = int(r.integers(a, n + 1))
        assert (grammar.ids_between(symbols, kinds, rules, lengths, a, b) == ids[a:b]).all()


def test_grammar_finds_what_repeats():
    ids = np.tile(np.arange(64, dtype=np.uint32), 1000)
    rules, lengths, symbols = grammar.compress(ids, 64)
    assert len(symbols) < len(ids) / 100 and len(rules) < 300
    ones = np.zeros(1 << 16, np.uint32)
    rules, lengths, symbols = grammar.compress(ones, 1)
    assert len(symbols) <= 16 and lengths.max() >= 1 << 12


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = grammar.write(empty)
    assert grammar.read(spark, path).count() == 0
    assert len(grammar.read_between(spark, path, 0, 5)) == 0


def test_query(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    import zlib

    for d in docs:
        ids = array("I", [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0])
        want.append((d.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op13_pair_grammar"](spark, FOLDER)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_known_pieces_are_not_encoded_again(monkeypatch):
    """Neither words, nor first words of texts, nor tails go to the library twice."""
    encoder, seen = grammar.Encoder(PATH), []
    texts = pa.array([f"First one, and étai{c} the rest{t}\nmore" for c in "abc" for t in (".", ",", "?!", "")])
    want = encoder.tokens(texts)
    tokenizer = Tokenizer.from_file(PATH)
    assert [list(array("I", b)) for b in want] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]

    class Counted:
        def encode_batch_fast(self, given, **more):
            seen.extend(given)
            return tokenizer.encode_batch_fast(given, **more)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    assert encoder.tokens(texts.slice(3)) == want[3:]
    assert not any(seen)


def test_white_space_of_every_kind():
    tokenizer, encoder = Tokenizer.from_file(PATH), grammar.Encoder(PATH)
    gaps = [" ", "\n", "\t", "\x85", "\xa0", " ", "᠎", " ", " ", " ", "　", "\r", "\x1c", "\0"]
    texts = [f"é{a}{b}{c}é, あ{b}{c}x{a}" for a in gaps for b in ["", *gaps] for c in gaps[:4]]
    got = encoder.tokens(pa.array(texts))
    assert [list(array("I", b)) for b in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_have_one_number_each(monkeypatch):
    from keyloom.llm import words

    monkeypatch.setattr(words, "AT_ONCE", 100)
    r, table = np.random.default_rng(3), words.Words()
    said, known = [], {}
    for turn in range(4):
        run = [bytes(r.integers(0 if turn % 2 else 1, 4, int(n)).astype(np.uint8)) for n in r.integers(1, 20, 3000)]
        sizes = np.array([len(x) for x in run])
        numbers, first = table.numbers(words.padded(b"".join(run)), np.cumsum(sizes) - sizes, sizes)
        assert sorted(numbers[first].tolist()) == list(range(len(known), table.size))
        for x, n in zip(run, numbers.tolist()):
            assert known.setdefault(x, n) == n
        said += run
    assert set(table) == set(known) == set(said) and table.size == len(known)
    chosen = np.arange(table.size) % 3 == 0
    table.retain(chosen)
    left = [x for x, n in known.items() if chosen[n]]
    sizes = np.array([len(x) for x in left])
    numbers, first = table.numbers(words.padded(b"".join(left)), np.cumsum(sizes) - sizes, sizes)
    assert numbers.tolist() == [known[x] // 3 for x in left] and not len(first) and set(table) == set(left)
