"""Reproducible shuffle into shards by a keyed permutation of global row numbers.

Rows are numbered 0 … n-1 in the order (id, length, CRC, hash of the text). A Feistel network
over Z_a x Z_b with a*b just above n permutes the numbers; a value of n or more walks the
cycle until it lies below n. Shard and slot follow from the permuted number y alone:
shard = y mod shards, slot = y div shards. Hence the law is ``rows``: shard sizes differ by one
row at most, slots have no gap, and ``place`` computes where any row number goes without data.

Only built-in expressions are used. Texts never move: the sort carries ids, sizes and hashes.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.prefix import FILE, ROW, sorted_table

PRIME = 2**31 - 1
ROUNDS = 6
# Steps of the cycle walk before a row is refused; see ``permuted`` for why it never is.
WALK = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(multiplier, addend, offset) of each round, derived from the seed."""
    keys, state = [], (seed % PRIME) or 1
    for _ in range(rounds):
        row = []
        for _ in range(3):
            state = state * 48271 % PRIME  # the minimal standard generator
            row.append(state)
        keys.append(tuple(row))
    return keys


def sides(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def place(number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row number, in plain Python."""
    a, b = sides(n)
    y = number
    while True:
        left, right = y % a, y // a
        for i, (m, c, d) in enumerate(round_keys(seed)):
            t = ((right if i % 2 == 0 else left) % PRIME * m + c) % PRIME
            t = (t * t + d) % PRIME
            left, right = ((left + t) % a, right) if i % 2 == 0 else (left, (right + t) % b)
        y = right * a + left
        if y < n:
            return y % shards, y // shards


def permuted(number: Column, n: int, seed: int) -> Column:
    """The permuted row number as an expression.

    A cycle holds at most a*b - n < sqrt(n) + 1 values to walk over, and a step meets one with
    probability below 1/sqrt(n): for tables so small that ``WALK`` steps are likely, they are
    also more than the cycle can hold. Beyond the bound the query fails rather than misplace.
    """
    a, b = sides(n)
    keys = F.array(
        *[
            F.struct(
                F.lit(m).cast("long").alias("m"),
                F.lit(c).cast("long").alias("c"),
                F.lit(d).cast("long").alias("d"),
                F.lit(i % 2 == 0).alias("even"),
            )
            for i, (m, c, d) in enumerate(round_keys(seed))
        ]
    )
    prime, wide, high = (F.lit(x).cast("long") for x in (PRIME, a, b))

    def mixed(v: Column, k: Column) -> Column:
        linear = (v % prime * k["m"] + k["c"]) % prime
        return F.transform(F.array(linear), lambda t: (t * t + k["d"]) % prime)[0]

    def step(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        return F.when(
            k["even"], F.struct(((left + mixed(right, k)) % wide).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), ((right + mixed(left, k)) % high).alias("r")))

    def network(x: Column) -> Column:
        start = F.struct((x % wide).alias("l"), ((x - x % wide) / wide).cast("long").alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["r"] * wide + s["l"])

    limit = F.lit(n).cast("long")
    steps = F.sequence(F.lit(1), F.lit(min(WALK, max(1, a * b - n))))
    y = F.aggregate(steps, network(number), lambda y, _: F.when(y < limit, y).otherwise(network(y)))
    return F.when(y < limit, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``number``, the global row number in ``order``; also the row count.

    A range sort written once; the offsets are one small row per written file.
    """
    table = sorted_table(rows, order)
    counts = table.groupBy(FILE).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__start", F.coalesce(before, F.lit(0))).select(FILE, "__start")
    total = table.count()
    placed = table.join(F.broadcast(offsets), FILE)  # a row per file
    return placed.withColumn("number", F.col("__start") + F.col(ROW)).select(*rows.columns, "number"), total


def assign(
    docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, law, number, shard, slot) of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16; a null text counts as empty (size 16, CRC 0).
    A null id sorts first. Equal rows get numbers side by side and their own slots. Empty
    input gives no rows. Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    placed, n = numbered(rows, rows.columns)
    y = permuted(F.col("number"), n, seed)
    return placed.withColumn("y", y).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "number",
        (F.col("y") % shards).cast("int").alias("shard"),
        ((F.col("y") - F.col("y") % shards) / shards).cast("long").alias("slot"),
    )
