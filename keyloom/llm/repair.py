"""Repair of conversations: the cheapest edits that give legal turns, by Hirschberg's method.

A legal conversation has roles ``(s?(ua)+)?`` by initials. Edits of a row are Keep (0), Rerole to
user or assistant (2) and Delete (3; blank and repeated rows must go); an empty user or assistant
turn may be Inserted anywhere (2); a truncated row that stays costs 1. After each row a repair is
in one of four states: nothing yet, after s, after u, after a. Edits of a row take a state to
another at a known cost, so a row is a 4 x 4 table of costs, and so is any stretch of rows.

Of equally cheap repairs the one with the least audit (initials of its edits, ASCII order) is
wanted. Audits that lead to different states never begin one another when cut behind a row's own
edit, so it is enough to know the order of the states' least audits: a forward vector holds four
costs and four ranks. Forward and backward vectors meet mid-way; the cheapest, then least
crossing state is fixed; both halves are repaired alike, in linear space (``crossings``).

Rows are numbered by range partitions, and conversations are cut into chunks of ``CHUNK`` rows.
Chunks are joined to tables of ``FAN`` chunks, and so on, and the crossings between chunks are
found from the top down by the same method; so a conversation of any length is repaired by
tasks that hold a chunk or ``FAN`` tables. Texts play no part but at the ends: when faults are
told, and when repaired turns are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.keys import quoted
from ..plans.prefix import FILE, ROW, numbered_files, running
from ..plans.shared import materialise
from .groups import schema_of
from .workers import kept

CHUNK, FAN = 1024, 1024
HEAD = 64
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state that an inserted or reroled turn leads to
ROLES = {USER: "user", ASSISTANT: "assistant"}
# Inserts that end a repair, by state.
ENDING = ("", "II", "I", "")
# Repairs kept by a worker, of chunks up to so many rows.
KEPT, SHORT = 200_000, 32
WHITE = r"\x20\x09-\x0D"

Table = tuple[tuple, tuple]  # 4 x 4 costs, 4 x 4 ranks of the audits from one state


def edits(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> cost and least audit of one row's edits, inserts first.

    Codes are the role's initial (``x``: neither s, u nor a), upper case for truncated rows;
    ``d`` must be deleted.
    """
    found: dict[tuple[int, int], tuple[int, str]] = {}
    late = int(code.isupper())
    for before in range(4):
        at = before
        for inserts in range(3):
            ways = [(3, "D", at)]
            if code != "d":
                ways.append((2 + late, "R", NEXT[at]))
                if code.lower() == "s" and at == START:
                    ways.append((late, "K", SYSTEM))
                if code.lower() == ("a" if at == USER else "u"):
                    ways.append((late, "K", NEXT[at]))
            for cost, edit, after in ways:
                way = (2 * inserts + cost, "I" * inserts + edit)
                found[before, after] = min(found.get((before, after), way), way)
            at = NEXT[at]
    return found


EDITS = {code: edits(code) for code in "suaxSUAXd"}


def ranks_of(keys: Sequence) -> tuple[int, ...]:
    order = sorted(range(4), key=lambda t: keys[t])
    return tuple(order.index(t) for t in range(4))


def row_table(code: str) -> Table:
    ways = EDITS[code]
    costs = tuple(tuple(ways[s, t][0] if (s, t) in ways else NEVER for t in range(4)) for s in range(4))
    names = [[ways[s, t][1] if (s, t) in ways else "~" for t in range(4)] for s in range(4)]
    return costs, tuple(ranks_of(n) for n in names)


ROW_TABLES = {code: row_table(code) for code in EDITS}


def advance(cost: Sequence[int], rank: Sequence[int], table: Table) -> tuple[list[int], tuple[int, ...]]:
    """Forward costs and ranks behind a stretch, from those before it."""
    costs, order = table
    chosen = [min([(cost[s] + costs[s][t], rank[s], s) for s in range(4)]) for t in range(4)]
    return [min(c, NEVER) for c, _, _ in chosen], ranks_of([(r, order[s][t]) for t, (_, r, s) in enumerate(chosen)])


def forward(tables: Sequence[Table], first: int) -> tuple[list[int], tuple[int, ...]]:
    cost, rank = [0 if s == first else NEVER for s in range(4)], (0, 1, 2, 3)
    for table in tables:
        cost, rank = advance(cost, rank, table)
    return cost, rank


def backward(tables: Sequence[Table], last: int) -> list[int]:
    rest = [0 if s == last else NEVER for s in range(4)]
    for costs, _ in reversed(tables):
        rest = [min([costs[s][t] + rest[t] for t in range(4)]) for s in range(4)]
    return rest


def joined(tables: Sequence[Table]) -> Table:
    """The table of a stretch from those of its parts."""
    rows = [forward(tables, s) for s in range(4)]
    return tuple(tuple(c) for c, _ in rows), tuple(r for _, r in rows)


def crossings(tables: Sequence[Table], first: int, last: int) -> list[int]:
    """The states before, between and behind the parts, of the cheapest and then least repair."""
    states = [first, *[0] * (len(tables) - 1), last]
    todo = [(0, len(tables))]
    while todo:
        low, high = todo.pop()
        if high - low > 1:
            middle = (low + high) // 2
            cost, rank = forward(tables[low:middle], states[low])
            rest = backward(tables[middle:high], states[high])
            states[middle] = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
            todo += [(low, middle), (middle, high)]
    return states


def last_state(table: Table) -> int:
    """Where the best repair of a whole conversation ends, before closing inserts."""
    costs, ranks = table
    return min(range(4), key=lambda t: (costs[START][t] + 2 * len(ENDING[t]), ranks[START][t]))


def repair_rows(codes: str, first: int, last: int | None, final: bool) -> tuple[str, str, int]:
    """(audit, roles given, cost) of a stretch; ``last`` None is the best end of a conversation.

    Roles given are ``u`` or ``a`` for each inserted or reroled turn, ``-`` for other edits.
    """
    tables = [ROW_TABLES[c] for c in codes]
    if last is None:
        cost, rank = forward(tables, first)
        last = min(range(4), key=lambda t: (cost[t] + 2 * len(ENDING[t]), rank[t]))
    states = crossings(tables, first, last) if tables else [first]
    audit, roles, total = [], [], 0
    for code, s, t in zip(codes, states, states[1:]):
        cost, text = EDITS[code][s, t]
        total += cost
        audit.append(text)
        for edit in text:
            given = edit in "IR"
            roles.append("-ua"[(0, 0, 1, 2)[NEXT[s]]] if given else "-")
            s = NEXT[s] if given else s
    if final:
        audit.append(ENDING[last])
        total += 2 * len(ENDING[last])
        roles.append({"II": "ua", "I": "a", "": ""}[ENDING[last]])
    return "".join(audit), "".join(roles), total


def classify(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): the written rows, and for each one its position, fault and initial."""
    space = F.lit(" ")
    rows = numbered_files(
        turns.select(
            F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"),
            F.coalesce(F.col(quoted(role_col)).cast("string"), space).alias("role"),
            F.coalesce(F.col(quoted(text_col)).cast("string"), space).alias("text"),
        )
    ).withColumnsRenamed({FILE: "from_file", ROW: "from_row"})
    initial = F.substring("role", 1, 1)
    both = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    narrow = rows.select(
        "conv", "turn", F.substring("role", 1, HEAD).alias("role_head"), F.substring("text", 1, HEAD).alias("head"),
        F.unhex(F.sha2(both, 256)).alias("digest"), "from_file", "from_row",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~F.col("text").rlike(f"[^{WHITE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")).alias("cut"),
        F.lit(1).alias("one"),
    )
    order = ["turn", "role_head", "head", "digest", "from_file", "from_row"]
    placed = materialise(running(narrow, ["conv"], order, {"pos": ("one", "sum")}), "placed")
    again = placed.groupBy("conv", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = again.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("pos") > F.col("first"), "duplicate")
        .when(F.col("cut"), "truncated")
    )
    classes = placed.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").select(
        "conv", "turn", "pos", "initial", fault.alias("fault"), "from_file", "from_row"
    )
    return rows, materialise(classes, "classes")


def chunks_of(classes: DataFrame) -> DataFrame:
    """(conv, chunk, rows): consecutive rows of a conversation, in order."""
    code = (
        F.when(F.col("fault").isin("blank", "duplicate"), "d")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    item = F.struct("pos", code.alias("code"), "initial", "from_file", "from_row")
    chunk = F.floor(F.col("pos") / CHUNK)
    return classes.groupBy("conv", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("rows"))


def _flat(table: Table) -> tuple[list[int], list[int]]:
    return [c for row in table[0] for c in row], [r for row in table[1] for r in row]


def _table(costs: Sequence[int], ranks: Sequence[int]) -> Table:
    quarter = range(0, 16, 4)
    return tuple(tuple(costs[i : i + 4]) for i in quarter), tuple(tuple(ranks[i : i + 4]) for i in quarter)


TABLE = "costs array<long>, ranks array<int>"


def chunk_tables(chunks: DataFrame) -> DataFrame:
    """(conv, idx, costs, ranks): the table of each chunk."""
    kind = chunks.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, idx long, {TABLE}"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [_flat(joined([ROW_TABLES[c] for c in codes])) for codes in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([c for c, _ in flat], schema.field(2).type),
                    pa.array([r for _, r in flat], schema.field(3).type),
                ],
                schema=schema,
            )

    codes = F.array_join(F.transform("rows", lambda r: r["code"]), "")
    return chunks.select("conv", F.col("chunk").alias("idx"), codes.alias("codes")).mapInArrow(run, ddl)


def _fans(tables: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("idx", "costs", "ranks")))
    return tables.groupBy("conv", F.floor(F.col("idx") / FAN).alias("up")).agg(held.alias("parts"))


def _parts(value: pa.Scalar) -> list[Table]:
    return [_table(p["costs"], p["ranks"]) for p in value.as_py()]


def joined_tables(tables: DataFrame) -> DataFrame:
    """(conv, idx, costs, ranks): the tables of runs of FAN tables."""
    kind = tables.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, idx long, {TABLE}"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [_flat(joined(_parts(v))) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([c for c, _ in flat], schema.field(2).type),
                    pa.array([r for _, r in flat], schema.field(3).type),
                ],
                schema=schema,
            )

    return _fans(tables).select("conv", "up", "parts").mapInArrow(run, ddl)


def boundary_states(chunks: DataFrame) -> DataFrame | None:
    """(conv, chunk, first, last, final): the crossings of conversations of several chunks."""
    most = chunks.agg(F.max("chunk")).first()[0] or 0
    if most == 0:
        return None
    several = chunks.filter("chunk > 0").select(F.col("conv").alias("c")).distinct()
    long_ones = chunks.join(several, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    levels = [materialise(chunk_tables(long_ones), "tables")]
    while most > 0:
        levels.append(materialise(joined_tables(levels[-1]), "tables"))
        most //= FAN
    kind = chunks.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, idx long, first int, last int, final boolean"
    schema = schema_of(ddl)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, ranks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            last = [last_state(_table(c, r)) for c, r in zip(costs, ranks, strict=True)]
            n = batch.num_rows
            columns = [batch.column(0), batch.column(1), np.full(n, START, np.int32), np.array(last, np.int32), np.ones(n, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (up, first, last, final) in enumerate(zip(*[batch.column(k).to_pylist() for k in (1, 2, 3, 4)], strict=True)):
                states = crossings(_parts(batch.column(5)[i]), first, last)
                n = len(states) - 1
                conv = pa.array([batch.column(0)[i].as_py()] * n, schema.field(0).type)
                idx = pa.array(np.arange(up * FAN, up * FAN + n))
                ends = np.zeros(n, bool)
                ends[-1] = final
                halves = [pa.array(np.array(s, np.int32)) for s in (states[:-1], states[1:])]
                yield pa.RecordBatch.from_arrays([conv, idx, *halves, pa.array(ends)], schema=schema)

    states = levels[-1].mapInArrow(whole, ddl)
    for tables in reversed(levels[:-1]):
        fans = _fans(tables).withColumnRenamed("conv", "c")
        both = states.join(fans, F.col("conv").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("up")))
        states = materialise(both.select("conv", "idx", "first", "last", "final", "parts").mapInArrow(down, ddl), "states")
    return states.withColumnRenamed("idx", "chunk")


OP = "struct<op: string, role: string, from_file: bigint, from_row: bigint>"


def solve(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, audit, cost, edits): the repair of each chunk; edits name the rows they are about."""
    states = boundary_states(chunks)
    if states is None:
        given = chunks.withColumns({"first": F.lit(START), "last": F.lit(None).cast("int"), "final": F.lit(True)})
    else:
        side = states.withColumnsRenamed({"conv": "c", "chunk": "k"})
        given = chunks.join(side, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left")
    kind = chunks.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, chunk long, audit string, cost long, edits array<{OP}>"
    schema = schema_of(ddl)
    codes = F.array_join(F.transform("rows", lambda r: r["code"]), "")
    given = given.select(
        "conv", "chunk", codes.alias("codes"), F.coalesce("first", F.lit(START)).alias("first"), "last",
        F.coalesce("final", F.lit(True)).alias("final"),
        F.transform("rows", lambda r: r["from_file"]).alias("files"), F.transform("rows", lambda r: r["from_row"]).alias("places"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept("repair")
        for batch in batches:
            found = []
            for codes, *ends in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)], strict=True):
                key = (codes, *ends)
                answer = memory.get(key)
                if answer is None:
                    answer = repair_rows(codes, *ends)
                    if len(codes) <= SHORT:
                        if len(memory) >= KEPT:
                            memory.clear()
                        memory[key] = answer
                found.append(answer)
            # an insert is about no row; every other edit is about the next one
            audits = "".join([a for a, _, _ in found])
            edit = np.frombuffer(audits.encode(), np.uint8)
            about = edit != ord("I")
            row = np.cumsum(about) - 1
            role = np.frombuffer("".join([r for _, r, _ in found]).encode(), np.uint8)
            names = pa.array([None, "user", "assistant"])
            which = (role == ord("u")) * 1 + (role == ord("a")) * 2
            rows = pa.array(row, mask=~about)
            columns = [
                pa.array(list(audits), pa.string()), names.take(pa.array(which)),
                batch.column(6).flatten().take(rows), batch.column(7).flatten().take(rows),
            ]
            offsets = pa.array(np.cumsum([0, *[len(a) for a, _, _ in found]]), pa.int32())
            edits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["op", "role", "from_file", "from_row"]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([a for a, _, _ in found], pa.string()),
                    pa.array([c for *_, c in found], pa.int64()), edits.cast(schema.field(4).type),
                ],
                schema=schema,
            )

    return given.mapInArrow(run, ddl)


def _illegal() -> Column:
    """Neighbours whose initials may not follow each other, in a conversation's chunks in order."""
    inner = F.transform("parts", lambda p: p["inner"])
    n = F.size("parts")
    pairs = F.zip_with(
        F.slice("parts", 1, n - 1), F.slice("parts", 2, n), lambda a, b: F.concat(a["ending"], b["beginning"])
    )
    bad = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    return F.aggregate(inner, F.lit(0).cast("long"), lambda a, x: a + x) + bad


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired) of all conversations.

    ``reports``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. ``repaired``:
    conv_id, chunk, at, op, role, text; the turns of a repair in the order of chunk and at.

    Rows follow turn, nulls first; rows of one turn follow role, text and its digest (of role and
    text, 64 characters each). Null roles and texts are one space; null conversation ids are one
    conversation; repeated rows are duplicates. An empty table has neither reports nor repairs.
    Other columns are not read. A conversation may have any number of rows: a task holds 1024
    of them, without texts, or the tables of 1024 such chunks; its audit is one string.
    """
    rows, classes = classify(turns, conv_col, turn_col, role_col, text_col)
    chunks = materialise(chunks_of(classes), "chunks")
    solved = materialise(solve(chunks), "solved")
    counts = [
        F.count(F.when(F.col("fault") == name, 1)).alias(name) for name in ("blank", "duplicate", "truncated")
    ]
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    told = classes.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), *counts)
    initials = F.array_join(F.transform("rows", lambda r: r["initial"]), "")
    n = F.length("initials")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.col("initials").substr(i, F.lit(2))))
    inner = F.size(F.filter(F.coalesce(pairs, F.array().cast("array<string>")), lambda p: ~p.isin("su", "ua", "au")))
    parts = chunks.select("conv", "chunk", initials.alias("initials")).select(
        "conv",
        F.struct(
            "chunk", inner.alias("inner"), F.substring("initials", 1, 1).alias("beginning"),
            F.substring("initials", -1, 1).alias("ending"),
        ).alias("part"),
    )
    met = parts.groupBy("conv").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    audits = solved.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("chunk", "audit"))).alias("audits")
    )
    reports = (
        told.join(met.select(F.col("conv").alias("c1"), _illegal().alias("illegal")), F.col("conv").eqNullSafe(F.col("c1")))
        .join(audits.withColumnRenamed("conv", "c2"), F.col("conv").eqNullSafe(F.col("c2")))
        .select(
            F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
            F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit"),
        )
    )
    every = solved.select("conv", "chunk", F.posexplode("edits").alias("at", "e")).select("conv", "chunk", "at", "e.*")
    inserted = every.filter("op = 'I'").select("conv", "chunk", "at", "op", "role", F.lit("").alias("text"))
    stay = every.filter("op in ('K', 'R')").withColumnsRenamed({"conv": "c", "role": "given"})
    kept_rows = stay.join(rows, ["from_file", "from_row"]).select(
        F.col("c").alias("conv"), "chunk", "at", "op", F.coalesce("given", "role").alias("role"), "text"
    )
    return reports, kept_rows.unionByName(inserted).withColumnRenamed("conv", "conv_id")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of a repair's ``role:text`` lines.

    A conversation's turns are sorted, spilling where they must, and run through one digest,
    which is sequential by nature: a task holds a batch of them, however many there are.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, repaired_sha256 string"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                line = f"{role}:{text}".encode()
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n")
                    digest.update(line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], schema.field(0).type), pa.array([digest.hexdigest()])], schema=schema
            )

    order = ["conv_id", "chunk", "at"]
    return repaired.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, ddl)
