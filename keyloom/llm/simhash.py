"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's bit is set if it is set in more than half of the hashes of the text's word
shingles. Two fingerprints that differ in at most 4 bits, cut into 3 segments, have a segment
that differs in at most one bit: it becomes equal when that bit is wiped. So each segment is
indexed once per wiped bit (64 keys in all), equal keys bring fingerprints together, and all
64 bits are compared then. Nothing is missed and nothing false is linked.

Copies share a fingerprint and enter the index once. Inside a key group only links to the
group's smallest connected fingerprint are given out, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import materialise

from . import groups
from .components import components
from .workers import kept

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
MAX_BITS = 4
LANES = np.uint64(0x0101010101010101)
# Texts worked on at once, in bytes.
PIECE = 16 << 20


def shingle_digests(text: bytes, words: int, seed: int) -> list[bytes]:
    ws = text.lower().split()  # on bytes: A-Z only, and exactly the blanks 0x20 and 0x09-0x0D
    if len(ws) <= words:
        return [xxhash.xxh64_digest(b" ".join(ws), seed)] if ws else []
    joined = b" ".join(ws)
    ends = list(accumulate(map(len, ws), lambda a, n: a + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-words]]
    digest = xxhash.xxh64_digest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=True)]


def majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes; ``sizes`` are the runs' lengths, 0 gives 0."""
    result = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    starts = np.cumsum(sizes)[full] - sizes[full]
    # byte lanes hold up to 255: cut the runs there, then add the parts
    parts = -(-sizes[full] // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    half = sizes[full]
    for shift in range(8):
        lane = (values >> np.uint64(shift)) & LANES
        sums = np.add.reduceat(lane, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        count = np.add.reduceat(sums, first, axis=0)
        for byte in range(8):
            bit = (2 * count[:, byte] > half).astype(np.uint64)
            result[full] |= bit << np.uint64(8 * byte + shift)
    return result


def fingerprint_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints, digests, sizes, held = [], [], [], 0
            for x in texts:
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                own = shingle_digests(raw, words, seed)
                digests += own
                sizes.append(len(own))
                held += len(raw)
                if held > PIECE:
                    prints.append(majority(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64), np.array(sizes, np.int64)))
                    digests, sizes, held = [], [], 0
            prints.append(majority(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64), np.array(sizes, np.int64)))
            made = pa.array(np.concatenate(prints).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fp``, the fingerprint as a signed long.

    A null text is like an empty one: fingerprint 0. ``keep`` may hold any columns.
    """
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    return chosen.mapInArrow(fingerprint_batches(words, seed), f"{kinds}, fp long")


def signatures(fp: Column) -> Column:
    """The 64 keys of a fingerprint: segment, wiped bit, and the other bits of the segment."""
    keys = []
    for number, (first, bits) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        for bit in range(bits):
            keys.append(
                segment.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << bit))).bitwiseOR(F.lit(((number * 32 + bit) << 32)))
            )
    return F.array(*keys)


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def comparers(max_bits: int):
    def dense(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        adjacent = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), 256):
            adjacent[at : at + 256] = near(x[at : at + 256, None], x[None, :], max_bits)
        root = groups.roots(adjacent)
        moved = np.flatnonzero(root != np.arange(len(x)))
        return x[moved], x[root[moved]]

    def within(starts: np.ndarray, chunk: pa.Table) -> dict:
        x = chunk.column("fp").to_numpy().view(np.uint64)
        sizes = np.diff(np.append(starts, len(x)))
        left, right = [], []
        for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
            a, b = dense(x[s : s + n])
            left.append(a)
            right.append(b)
        few = np.where(sizes <= 16, sizes, 0)
        after = np.repeat(starts + few, sizes) - np.arange(len(x))  # rows left in a small run, this one included
        for lag in range(1, int(few.max(initial=0))):
            at = np.flatnonzero(after > lag)
            at = at[near(x[at], x[at + lag], max_bits)]
            left.append(x[at])
            right.append(x[at + lag])
        return unique(left, right)

    def across(one: pa.Table, two: pa.Table) -> dict:
        # links of one block to the other: each row with the first row it meets, both ways
        x, y = (t.column("fp").to_numpy().view(np.uint64) for t in (one, two))
        adjacent = np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), 256):
            adjacent[at : at + 256] = near(x[at : at + 256, None], y[None, :], max_bits)
        n = len(x) + len(y)
        whole = np.zeros((n, n), bool)
        whole[: len(x), len(x) :] = adjacent
        whole[len(x) :, : len(x)] = adjacent.T
        root = groups.roots(whole)
        z = np.concatenate([x, y])
        moved = np.flatnonzero(root != np.arange(n))
        return unique([z[moved]], [z[root[moved]]])

    def unique(left: list, right: list) -> dict:
        if not left:
            return {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return {"a": np.ascontiguousarray(pairs[:, 0]).view(np.int64), "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)}

    return within, across


def clusters(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, cluster) for every fingerprint that is linked to another one."""
    keyed = prints.select("fp").distinct().select(F.explode(signatures(F.col("fp"))).alias("key"), "fp")
    within, across = comparers(max_bits)
    links = groups.compare(keyed, "key", within, across, "a long, b long", tag="simhash")
    found = components(links.distinct(), "simhash")
    return found.select(F.col("node").alias("fp"), F.col("root").alias("cluster"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42
) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id of the texts reachable by links, its own included; null
    ids are passed over, and it is null where a component has no other. Texts without words
    (null, empty, blank) share fingerprint 0. Repeated rows are copies. Empty input gives no
    rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(fingerprints(own, ["doc_id"], "text", words, seed), "fingerprints")
    return prints.join(_smallest(prints), prints["fp"] == F.col("of_fp")).select("doc_id", "fp", "component_id")


def _smallest(prints: DataFrame) -> DataFrame:
    """(of_fp, component_id) for every fingerprint."""
    found = materialise(clusters(prints), "clusters")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = least.join(found.withColumnRenamed("fp", "c_fp"), F.col("fp") == F.col("c_fp"), "left").select(
        "fp", F.coalesce("cluster", "fp").alias("cluster"), "least"
    )
    whole = placed.groupBy(F.col("cluster").alias("of_cluster")).agg(F.min("least").alias("component_id"))
    return placed.join(whole, F.col("cluster") == F.col("of_cluster")).select(F.col("fp").alias("of_fp"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their component; all columns, in order.

    Rows that share an id are one document. Rows without an id cannot be named and stay.
    """
    found = near_duplicates(docs, id_col, text_col, words)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("g_id")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("g_id"), "left_anti")
