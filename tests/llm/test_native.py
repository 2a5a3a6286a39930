"""Line rules, license rules, sharding and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.llm import chat, licenses, line_rules, sharding
from keyloom.llm.queries import ORACLES, QUERIES
from tools import check

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# nulls, empty and white texts, ties, repeated rows
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one\ntwo\none\n\n ONE", "en", None, 1),
    (4, "one\ntwo\none\n\n ONE", "en", None, 1),
    (None, "a b c d e f g h " * 3, "en", "a", 1),
    (5, "\n lead " + "x " * 40, "en", "b", 1),
    (6, "MIT License, mit-license: General Public License. İK mit license", "en", "b", 1),
    (7, "Licensed under the MIT License version 2 All Rights Reserved", "en", "b", 1),
    (8, "w%d " * 20000 % tuple(range(20000)), "en", "b", 1),
]


@pytest.fixture(scope="module")
def documents(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return given.union(spark.createDataFrame(ODD, DOCS).withColumn("doc_id", F.col("doc_id") + 100000))


@pytest.fixture(scope="module")
def raw(documents):
    return [tuple(r) for r in documents.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    ws = words(text)
    seen = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = Counter(seen)
    hit = {j for i, w in enumerate(seen) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)
    )


def normal(line):
    return " ".join(words(line)).lower()


def frequent(rows, min_docs, share):
    kinds, hosts = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        lines = frozenset(normal(x) for x in (text or "").split("\n") if words(x))
        if not lines:
            continue
        hashes = sorted(lines, key=lambda s: HASH[s])
        kind = (hashes[0], hashes[-1])
        hosts[host].add(kind)
        for x in lines:
            kinds[host, x].add(kind)
    return {k for k, v in kinds.items() if len(v) > min_docs and len(v) > len(hosts[k[0]]) * share}


HASH = {}


@pytest.fixture(scope="module")
def hashes(spark, raw):
    lines = sorted({normal(x) for r in raw for x in (r[1] or "").split("\n") if words(x)})
    table = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.xxhash64("x"))
    HASH.update({r[0]: r[1] for r in table.collect()})


@pytest.mark.parametrize("min_docs,share", [(10, 0.005), (1, 0.0)])
def test_line_rules(documents, raw, hashes, min_docs, share):
    got = line_rules.judge(documents, min_docs=min_docs, min_share=share)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept").collect()), key=repr)
    lines, want, texts = frequent(raw, min_docs, share), [], []
    for row in raw:
        b = base(row[1])
        gone = sum(len(words(x)) for x in (row[1] or "").split("\n") if words(x) and (row[3], normal(x)) in lines)
        failed = b[0] < 20 or b[4] * 100 > b[0] * 30
        poor = gone > 0 and (b[0] - gone < 20 or b[0] - gone < b[0] * 0.4)
        want.append((row[0], *b, gone, failed, not failed and not poor))
        if not failed and not poor:
            left = [x for x in (row[1] or "").split("\n") if not (words(x) and (row[3], normal(x)) in lines)]
            texts.append((row[0], "\n".join(left) if gone else row[1]))
    assert got == sorted(want, key=repr)
    kept = line_rules.clean(documents, min_docs=min_docs, min_share=share)
    assert kept.columns == documents.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=repr) == sorted(texts, key=repr)
    assert min_docs > 1 or lines


def test_line_rules_count_documents(spark):
    """Pages that are mostly boilerplate, copies of one page, and a host too large for the share."""
    schema, own = "doc_id long, text string, source string", "own line %d of page %d"
    many = " ".join(f"w{k}" for k in range(30))
    menu = [f"menu {k} of the site" for k in range(100)]
    pages = [(i, "\n".join(menu + [own % (k, i) for k in range(3)]), "menus") for i in range(60)]
    copies = [(100 + i, "\n".join(f"line {k} with own words" for k in range(20)), "copies") for i in range(60)]
    large = [(1000 + i, f"text {i} {many}" + ("\nsee also" if i < 110 else ""), "large") for i in range(23000)]
    rows = line_rules.judge(spark.createDataFrame(pages + copies + large, schema)).collect()
    got = {r.doc_id: (r.removed_lines, r.depleted) for r in rows}
    assert all(got[i] == (100, True) for i in range(60))
    assert all(got[100 + i] == (0, False) for i in range(60))
    assert all(got[1000 + i] == (int(i < 110), False) for i in range(23000))


def test_line_rules_empty(spark, documents):
    none = documents.limit(0).withColumn("n_words", F.lit("clash"))
    assert line_rules.judge(none).count() == 0 and line_rules.clean(none).count() == 0
    clash = documents.withColumn("n_words", F.lit("clash")).withColumn("host", F.lit(1))
    assert line_rules.judge(clash).filter("kept").count() > 0


def brute_licenses(text, rules):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    said = " " + " ".join(ws) + " "
    found = []
    for i, r in enumerate(rules):
        if f" {r.keyword}" in said:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", said):
                start = said[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, r.priority, i))
    live = [
        a for a in found
        if rules[a[3]].base or not any(
            b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and b != a
            and (b[2] < a[2] or (b[0], b[1]) != (a[0], a[1]) or b[3] < a[3])
            for b in found
        )
    ]
    at = [f[0] for f in found if rules[f[3]].base]
    return (
        len(ws), len(at), min(at, default=None), max(at, default=None),
        ",".join(sorted({rules[f[3]].label for f in found if rules[f[3]].base})),
        ",".join(sorted({rules[f[3]].label for f in live})),
        max((rules[f[3]].confidence for f in live), default=0.0), len(live),
    )


def test_licenses(documents, raw):
    rules = licenses.default_rules()
    assert len(rules) > 200
    got = sorted((tuple(r) for r in licenses.scan(documents).collect()), key=repr)
    want = sorted(((r[0], *brute_licenses(r[1], rules)) for r in raw), key=repr)
    assert got == want
    assert any(r[6] for r in want)


def test_licenses_every_rule_has_a_gate():
    for r in licenses.default_rules():
        sample = r.pattern + r.keyword
        assert any(g in sample for g in licenses.GATES), r


def said_by(pattern, chance):
    """A text that ``pattern`` matches: optional parts, alternatives and characters by chance."""

    def said(tree):
        out = ""
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                kind, of = chance.choice(arg)
                out += chr(of if str(kind) == "LITERAL" else chance.randint(*of))
            elif op == "BRANCH":
                out += said(chance.choice(arg[1]))
            elif op == "SUBPATTERN":
                out += said(arg[3])
            else:
                assert op == "MAX_REPEAT", op
                out += "".join(said(arg[2]) for _ in range(chance.randint(arg[0], min(arg[1], arg[0] + 1))))
        return out

    return said(re._parser.parse(pattern))


def test_licenses_rules_meet_their_own_texts(spark):
    """Each rule on texts made from its pattern alone, against a brute force without gates."""
    chance, rules = random.Random(5), licenses.default_rules()
    texts = [(r, said_by(r.pattern, chance)) for r in rules for _ in range(40)]
    for r, text in texts:
        assert re.fullmatch(r.pattern, text), (r, text)
        assert f" {r.keyword}" in f" {text} " and any(g in text for g in licenses.GATES), (r, text)
    rows = [(i, text) for i, (_, text) in enumerate(texts[::20])]
    rows += [(-1, "SPDX-License-Identifier: EPL-2.0"), (-2, "X11 License"), (-3, "// SPDX-License-Identifier: 0BSD")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(tuple(r) for r in found)
    free = [r._replace(keyword="") for r in rules]
    assert got == sorted((i, *brute_licenses(text, free)) for i, text in rows)
    assert all(r.n_found for r in found) and {r.doc_id: r.labels for r in found if r.doc_id < 0} == {-1: "epl", -2: "mit", -3: "bsd"}


def test_licenses_many_and_empty(spark, documents):
    many = spark.createDataFrame([(1, "mit license gnu general public license v2 " * 500)], "doc_id long, text string")
    row = licenses.scan(many).first()
    assert (row.n_base, row.first_word, row.last_word) == (1000, 0, 7 * 499 + 3)
    assert licenses.scan(documents.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000])
def test_places_are_a_permutation(n):
    placed = [sharding.place(i, n, 40, 42) for i in range(n)]
    assert len(set(placed)) == n
    by = defaultdict(list)
    for shard, slot in placed:
        by[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(documents, raw):
    got = [tuple(r) for r in sharding.assign(documents).collect()]
    n = len(raw)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in raw)
    assert Counter(r[:3] for r in got) == want
    assert sorted(r[4] for r in got) == list(range(n))
    assert all(sharding.place(r[4], n, 40, 42) == r[5:7] for r in got)
    again = [tuple(r) for r in sharding.assign(documents.repartition(5, "lang")).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert sharding.assign(documents.limit(0)).count() == 0


TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"),
    (1, 1, "assistant", "a <\\s> <\\/s> \\ [INST\\]"),
    (1, 2, None, None),
    (1, 3, "assistant", ""),
    (1, 4, "us\ner", "tail\n<s>"),
    (2, None, "assistant", "only"),
    (2, None, "assistant", "only"),
    (None, 5, "user", "no reply"),
    (3, 100, "assistant", "late"),
    (3, 1, "user", "x" * 100000),
]


def test_chat(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("example", F.lit("clash"))
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(chat.expand(turns)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in TURNS:
        by[conv].append((-1 if turn is None else turn, (role or "").replace("\n", " "), text or ""))
    for conv, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in rows)
        loss = "".join(x for _, r, x in rows if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[conv] == (len(rows), digest(said), len(loss), digest(loss)), conv
    whole = {(r[0], r[1]): (r[2], r[3]) for r in chat.whole_examples(chat.expand(turns)).collect()}
    assert len(whole) == sum(r[2] == "assistant" for r in TURNS)
    examples = {(r.conv_id, r.example): r for r in chat.expand(turns).collect()}
    for key, (context, target) in whole.items():
        assert len(context) == examples[key].context_chars and target.startswith("<s>assistant\n")
    assert whole[1, 1][0].startswith(whole[1, 0][0] + whole[1, 0][1])
    assert chat.digests(chat.expand(turns.limit(0))).count() == 0


def test_chat_examples_hold_their_context(spark):
    """Every example has all turns before its reply, and the digests are made from those examples."""
    said = [("assistant" if k % 3 == 2 else "user", f"text {k} </s>") for k in range(11)]
    turns = spark.createDataFrame([(1, k, *t) for k, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows = {r.example: r for r in chat.read_examples(chat.expand(turns)).collect()}
    ends = [3, 6, 9, 11]
    assert [[tuple(t) for t in rows[i].turns] for i in range(4)] == [said[:n] for n in ends]
    assert [rows[i].loss for i in range(4)] == [said[n - 1][1] if n < 11 else "" for n in ends]
    assert chat.digests(chat.expand(turns)).first().n_turns == 11


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(ORACLES[name])
    assert check.normal([tuple(r) for r in got.collect()], got.columns) == check.normal(want.fetchall(), want.columns)
