"""Conversation repair against a plain search over all edits, and across chunks of any size."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.llm import repair
from keyloom.llm.queries import ORACLES, QUERIES
from tools import check

WHITE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def fault(role, text, seen):
    if not text.strip(WHITE):
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "" if text.rstrip(WHITE)[-1] in ".!?" else "truncated"


def best(rows):
    """Least (cost, audit, lines) over all edits of (role, text, fault), by their roles so far."""
    ways = {"": (0, "", ())}

    def inserted(ways):
        for _ in range(2):
            for past, (cost, audit, lines) in list(ways.items()):
                role = "assistant" if past[-1:] == "u" else "user"
                keep(ways, past + role[0], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return ways

    def keep(ways, past, way):
        past = past[-1:]  # what may follow depends on the last turn alone
        ways[past] = min(ways.get(past, way), way)

    for role, text, wrong in rows:
        after = {}
        for past, (cost, audit, lines) in inserted(dict(ways)).items():
            keep(after, past, (cost + 3, audit + "D", lines))
            if wrong in ("blank", "duplicate"):
                continue
            late = wrong == "truncated"
            follows = "a" if past == "u" else "u"
            new = {"u": "user", "a": "assistant"}[follows]
            keep(after, follows, (cost + 2 + late, audit + "R", (*lines, f"{new}:{text}")))
            if role[:1] == follows or (role[:1] == "s" and past == ""):
                keep(after, role[0], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
        ways = after
    ends = inserted(dict(ways))
    return min(ends[p] for p in ("", "a") if p in ends)


def report(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of (turn, role, text) rows."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns]

    def order(row):
        t, r, x = row
        return (t is not None, t or 0, r[:64], x[:64], hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest())

    rows.sort(key=order)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, judged = set(), []
    for _, r, x in rows:
        judged.append((r, x, fault(r, x, seen)))
        seen.add((r, x))
    count = [sum(f == name for *_, f in judged) for name in ("blank", "duplicate", "truncated")]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
    cost, audit, lines = best(judged)
    assert LEGAL.fullmatch("".join(x[0] for x in lines))
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_edits_are_least():
    r = random.Random(5)
    code_of = {"blank": str.lower, "truncated": str.upper, "": str.lower}
    for _ in range(4000):
        rows = [(r.choice("suuaax"), "t", r.choice(["", "", "truncated", "blank"])) for _ in range(r.randint(0, 9))]
        codes = "".join("d" if f == "blank" else code_of[f](c) for c, _, f in rows)
        cost, audit, lines = best(rows)
        got = repair.repair_rows(codes, repair.START, None, True)
        assert (got[0], got[2]) == (audit, cost), codes
        given = [x[0] for x, e in zip(lines, audit.replace("D", "")) if e in "IR"]
        assert got[1].replace("-", "") == "".join(given)


def test_halves_meet_like_one_pass():
    """Tables of stretches say the same as their rows, however they are cut."""
    r = random.Random(6)
    for _ in range(400):
        rows = [repair.ROW_TABLES[r.choice("suaxSUAXd")] for _ in range(r.randint(2, 40))]
        cut = sorted(r.sample(range(1, len(rows)), min(3, len(rows) - 1)))
        parts = [repair.joined(rows[a:b]) for a, b in zip([0, *cut], [*cut, len(rows)])]
        last = repair.last_state(repair.joined(parts))
        states = repair.crossings(rows, 0, last)
        assert [states[i] for i in [0, *cut, len(rows)]] == repair.crossings(parts, 0, last)


def conversations():
    r = random.Random(7)
    rows = [
        (None, 1, "user", "Hi."), (None, None, "assistant", "Yo!"), (None, None, None, None), (1, None, None, None),
        (2, 5, "", "x"), (2, 5, "", "x"), (3, 1, "user", ""), (3, 2, "assistant", " \t"), (4, 9, "system", "Only."),
        (5, 1, "user", "a b" * 40 + "1."), (5, 1, "user", "a b" * 40 + "0."), (6, 0, "Σ", "é…?"), (7, 0, "user", "long " * 60000),
    ]
    words = ["Yes.", "No!", "why?", "and then", "", "  ", "ok.\n"]
    for conv, n in [(10 + i, i % 12) for i in range(60)] + [(90, 200), (91, 37)]:
        for i in range(n):
            text = r.choice(words) + ("" if r.random() < 0.5 else f" {i}.")
            rows.append((conv, i + r.choice([0, 0, 0, 1, 3]), r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    return rows


@pytest.mark.parametrize("chunk,fan", [(1024, 1024), (3, 2), (1, 3)])
def test_repair(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, chunk string, pos int")
    reports, repaired = repair.repair(df.repartition(5))
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*r[1:], hashes.get(r.conv_id, empty)) for r in reports.collect()}
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    assert got == {conv: report(turns) for conv, turns in by.items()}
    assert max(len(g[6]) for g in got.values()) >= 200


def test_equal_rows_beyond_a_task(spark, monkeypatch):
    """A conversation of equal rows: all but the first go, and no key holds them together."""
    monkeypatch.setattr(repair, "CHUNK", 64)
    monkeypatch.setattr(repair, "FAN", 8)
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    reports, repaired = repair.repair(df)
    row = reports.first()
    assert (row.duplicate, row.cost, row.audit) == (n - 1, 3 * (n - 1) + 2, "K" + "D" * (n - 1) + "I")
    assert [(r.role, r.text) for r in repaired.orderBy("chunk", "at").collect()] == [("user", "Hi."), ("assistant", "")]


def test_empty(spark):
    reports, repaired = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert reports.count() == 0 and repair.digests(repaired).count() == 0


def test_query_against_sql(spark, tmp_path):
    r = random.Random(8)
    words = ["Yes.", "No! Why?", "and then", "", None, "é. ", "ok.\n"]
    rows = [
        (r.choice([None, *range(40)]), r.choice([None, *range(8)]), r.choice(["user", "assistant", "system", None]), r.choice(words))
        for _ in range(400)
    ]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.sql(ORACLES["op11_conversation_repair"])
    names, want = result.columns, result.fetchall()
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert check.normal([tuple(x) for x in got.collect()], got.columns) == check.normal(want, names)
