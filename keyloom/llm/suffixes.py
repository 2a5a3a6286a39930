"""Removing every byte that a repeated 200-byte string covers, by sampled suffixes.

The plan is that of difference-cover suffix sorting: sort short names of sampled suffixes, go on
to names of longer stretches where those are equal, place the remaining suffixes by their offset
to the sampled one that follows, and compare neighbours. Two things differ, since sorting all
suffixes of the bytes would move more than ten times the input:

* The cover is the set of window minima instead of residues modulo 3. A window start i belongs to
  the position m(i) of the smallest hashed 8-gram among the next ``COVER``. Equal strings have it
  at the same offset, which is what a cover is for, and one sample serves about 50 suffixes.
* Only 200 bytes have to be told apart, so names are hashes and the recursion ends at the second
  name. Suffixes are brought together by names; they are not put into alphabetic order.

In detail, for each sample p with the starts l..r that belong to it:

1. ``core``: name of the bytes that all its windows share from p on; ``ctx``: name of all bytes
   of its windows, l to r + 200.
2. Samples are sorted by (core, ctx). Equal neighbours in both: all windows are repeated.
   Equal in core only: some may be, and one sample of each distinct ctx goes on, with its bytes.
3. Window starts of a core are placed by (offset to p, name of their 200 bytes) and neighbours
   compared. This settles every start, whichever place its twin is in.

Copies within an input batch are settled before the first shuffle, so that a passage that a
third of all documents share is sent once per batch. Cores with many contexts are compared in
blocks. A name is believed only with a second, independent one: 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import materialise

from . import groups
from .workers import kept

LENGTH = 200
GRAM = 8
COVER = 128
# Multipliers of the polynomial names (odd), and the seed of the byte values.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


class Names:
    """Hashes of any stretch of a byte string, from running sums modulo 2^64."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.values = np.random.default_rng(base).integers(0, 2**64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << (n + 1).bit_length()
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def name(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.down[start]


def naming(base: int) -> Names:
    table = kept("names")
    if base not in table:
        table[base] = Names(base)
    return table[base]


def grams(text: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position."""
    n = len(text) - GRAM + 1
    v = np.empty(n, np.uint64)
    padded = text + bytes(GRAM)
    for o in range(min(GRAM, n)):
        v[o::GRAM] = np.frombuffer(padded, "<u8", (n - o + GRAM - 1) // GRAM, o)
    v *= MIX
    v ^= v >> np.uint64(33)
    v *= MIX2
    return v


def samples(text: bytes, length: int, cover: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, l, r): the sampled positions and the window starts that belong to each."""
    low = np.uint64(0xFFFFFFFF)
    v = grams(text)
    best = (v & ~low) | np.arange(len(v), dtype=np.uint64)
    span = 1
    while span < cover:  # ``cover`` is a power of two
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    at = (best[: len(text) - length + 1] & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    left = np.concatenate([[0], cut])
    right = np.concatenate([cut, [len(at)]]) - 1
    return at[left], left, right


def pack_place(p, left, right):
    return (left << 32) | ((p - left) << 16) | (right - left)


def unpack_place(place):
    left = place >> 32
    return left + (place >> 16 & 0xFFFF), left, left + (place & 0xFFFF)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal ones, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > reach[:-1]
    ends = np.append(np.flatnonzero(first)[1:], len(start)) - 1
    return start[first], reach[ends]


SURE, ASK = 0, 1
# ``place`` holds (start, stop) as start << 32 | stop for SURE rows; a sample for ASK rows
ROW = "kind int, core long, ctx long, k1 long, k2 long, place long, more int"


def sampled(rows: DataFrame, length: int, cover: int) -> DataFrame:
    """The samples of all texts (k1, k2, text); what a batch settles itself comes as SURE rows."""
    schema = groups.schema_of(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = naming(BASES[0]), naming(BASES[1])
        for batch in batches:
            found: list[list] = [[], [], [], [], []]  # core, ctx, place, row, stop
            for i, value in enumerate(batch.column("text")):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                if len(text) < length:
                    continue
                p, left, right = samples(text, length, cover)
                data = np.frombuffer(text, np.uint8)
                core = one.name(one.sums(data), p, p + (length - cover + 1))
                ctx = two.name(two.sums(data), left, right + length)
                ctx = (ctx ^ (p - left).astype(np.uint64) * MIX) * MIX2 + (right - left).astype(np.uint64) * MIX
                for have, new in zip(found, (core, ctx, pack_place(p, left, right), np.full(len(p), i), right + length), strict=True):
                    have.append(new)
            if not found[0]:
                continue
            core, ctx, place, row, stop = map(np.concatenate, found)
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            order = np.lexsort((ctx, core))
            same = np.zeros(len(order), bool)
            same[1:] = (core[order][1:] == core[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
            again = same.copy()
            again[:-1] |= same[1:]
            sent = order[~same]
            yield from groups.as_batches(
                {
                    "kind": np.full(len(sent), ASK, np.int32), "core": core[sent].view(np.int64),
                    "ctx": ctx[sent].view(np.int64), "k1": k1[row[sent]], "k2": k2[row[sent]],
                    "place": place[sent], "more": again[~same].astype(np.int32),
                },
                len(sent), schema,
            )
            sure = np.sort(order[again])
            if len(sure):
                yield from groups.as_batches(spans(row[sure], place[sure] >> 32, stop[sure], k1, k2), None, schema)

    return rows.select("k1", "k2", "text").mapInArrow(run, ROW)


def spans(row: np.ndarray, start: np.ndarray, stop: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> dict:
    """SURE rows of the intervals of each row, joined where they touch. Dealt by document."""
    shift = row.astype(np.int64) << 33  # rows apart, so that one pass joins them all
    a, b = merged(shift + start, shift + stop)
    of, base = a >> 33, (a >> 33) << 33
    n = len(a)
    return {
        "kind": np.full(n, SURE, np.int32), "core": k1[of], "ctx": k2[of], "k1": k1[of], "k2": k2[of],
        "place": (a - base) << 32 | (b - base), "more": np.zeros(n, np.int32),
    }


def settled(rows: DataFrame, length: int) -> DataFrame:
    """Rows of ``sampled`` by core: SURE intervals, and one ASK row per context in doubt."""
    schema = groups.schema_of(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in groups.whole_runs(batches, ["core"], 100_000, None):
            kind = chunk.column("kind").to_numpy()
            through = chunk.filter(pa.array(kind == SURE))
            if len(through):
                yield from through.cast(schema).to_batches()
            t = chunk.filter(pa.array(kind == ASK)).combine_chunks()
            if not len(t):
                continue
            core, ctx, more, place = (t.column(c).to_numpy() for c in ("core", "ctx", "more", "place"))
            new_core, new_ctx = np.ones(len(t), bool), np.ones(len(t), bool)
            new_core[1:] = core[1:] != core[:-1]
            new_ctx[1:] = new_core[1:] | (ctx[1:] != ctx[:-1])
            of = np.cumsum(new_ctx) - 1
            count = np.bincount(of, weights=1 + more).astype(np.int64)
            sure = count[of] > 1
            told = sure & (more == 0)
            if told.any():
                k1, k2 = t.column("k1").to_numpy()[told], t.column("k2").to_numpy()[told]
                _, left, right = unpack_place(place[told])
                rows_of = np.arange(len(left))
                yield from groups.as_batches(spans(rows_of, left, right + length, k1, k2), None, schema)
            # contexts per core, and whether one of them is still without a twin
            which = np.cumsum(new_core) - 1
            contexts = np.bincount(which, weights=new_ctx)
            alone = np.bincount(which, weights=new_ctx & ~sure)
            ask = new_ctx & (contexts[which] > 1) & (alone[which] > 0)
            if ask.any():
                out = t.filter(pa.array(ask))
                out = out.set_column(out.schema.get_field_index("more"), "more", pa.array(sure[ask].astype(np.int32)))
                yield from out.cast(schema).to_batches()

    dealt = rows.repartition("core").sortWithinPartitions("core", "ctx")
    return dealt.mapInArrow(run, ROW)


def comparers(length: int):
    """Window starts of a core by (offset, name): those that meet another context."""

    def windows(t: pa.Table):
        place = t.column("place").to_numpy()
        p, left, right = unpack_place(place)
        data = t.column("bytes").combine_chunks() if isinstance(t.column("bytes"), pa.ChunkedArray) else t.column("bytes")
        size = np.array([len(x.as_buffer()) for x in data], np.int64)
        joined = np.frombuffer(b"".join(x.as_buffer() for x in data), np.uint8)
        starts = np.cumsum(size) - size
        n = right - left + 1
        row = np.repeat(np.arange(len(t)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        names = naming(BASES[1])
        name = names.name(names.sums(joined), starts[row] + at, starts[row] + at + length)
        offset = (p - left)[row] - at
        return row, at, (name ^ offset.astype(np.uint64) * MIX) * MIX2 + offset.astype(np.uint64)

    def told(t: pa.Table, row, at, hit) -> dict:
        alone = t.column("more").to_numpy() == 0
        hit = hit & alone[row]
        row, at = row[hit], at[hit]
        _, left, _ = unpack_place(t.column("place").to_numpy())
        if not len(row):
            return {"k1": np.zeros(0, np.int64), "k2": np.zeros(0, np.int64), "place": np.zeros(0, np.int64)}
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        found = spans(row, left[row] + at, left[row] + at + length, k1, k2)
        return {c: found[c] for c in ("k1", "k2", "place")}

    def within(starts: np.ndarray, chunk: pa.Table) -> dict:
        row, at, name = windows(chunk)
        run = np.zeros(len(chunk), np.int64)
        run[starts] = 1
        run = np.cumsum(run)[row]
        order = np.lexsort((name, run))
        same = np.zeros(len(order), bool)
        same[1:] = (run[order][1:] == run[order][:-1]) & (name[order][1:] == name[order][:-1])
        same[:-1] |= same[1:]
        hit = np.zeros(len(order), bool)
        hit[order] = same
        return told(chunk, row, at, hit)

    def across(one: pa.Table, two: pa.Table) -> dict:
        (r1, a1, n1), (r2, a2, n2) = windows(one), windows(two)
        first, second = told(one, r1, a1, np.isin(n1, n2)), told(two, r2, a2, np.isin(n2, n1))
        return {c: np.concatenate([first[c], second[c]]) for c in first}

    return within, across


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, k1, k2 and text. Rows equal in id and text share their keys, and their fate."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col).cast("string"), F.crc32(text.cast("binary")), F.lit(1)).alias("k2"),
        text.alias("text"),
    )


def repeated(docs: DataFrame, id_col: str, text_col: str, length: int, cover: int, block: int) -> DataFrame:
    """(k1, k2, places): the repeated intervals of each document that has any."""
    rows = keyed(docs, id_col, text_col, [])
    found = materialise(settled(sampled(rows, length, cover), length), "suffixes")
    ask = found.filter(F.col("kind") == ASK)
    by_doc = ask.groupBy("k1", "k2").agg(F.collect_set(F.struct("core", "place", "more")).alias("asked"))
    left = F.shiftrightunsigned("a.place", 32)
    size = F.col("a.place").bitwiseAND(F.lit(0xFFFF)) + F.lit(length)
    contexts = (
        by_doc.join(rows, ["k1", "k2"])
        .select("k1", "k2", F.col("text").cast("binary").alias("raw"), F.explode("asked").alias("a"))
        .select(
            F.col("a.core").alias("core"), F.col("a.place").alias("place"), F.col("a.more").alias("more"), "k1", "k2",
            F.substring("raw", left.cast("int") + 1, size.cast("int")).alias("bytes"),
        )
    )
    within, across = comparers(length)
    met = groups.compare(contexts, "core", within, across, "k1 long, k2 long, place long", block, "suffixes", chunk=8000)
    sure = found.filter(F.col("kind") == SURE).select("k1", "k2", "place").unionByName(met)
    return sure.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))


def remove(
    docs: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    cover: int = COVER,
    block: int = 4096,
    as_text: bool = False,
) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``kept`` (binary), n_bytes, n_removed, n_spans, kept_sha256.

    With ``as_text``, ``kept`` is a string, without what is left of characters that were cut.

    One row per row. A byte goes if a string of ``length`` bytes that covers it also starts
    elsewhere, in this or any other row; ``cover`` is a power of two below ``length``. A null
    text is empty; texts shorter than ``length`` stay whole. Repeated rows cover each other.
    Empty input gives no rows; no column of ``keep`` may have the name of a result.
    """
    places = materialise(repeated(docs, id_col, text_col, length, cover, block), "places")
    rows = keyed(docs, id_col, text_col, keep)
    marked = rows.join(places.withColumnsRenamed({"k1": "p1", "k2": "p2"}), (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")), "left")
    marked = marked.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"), F.col("places").alias("__places"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in marked.schema[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, places in zip(batch.column("__text"), batch.column("__places"), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone, n = 0, 0
                rest = raw
                if places.is_valid:
                    v = places.values.to_numpy(zero_copy_only=False)
                    start, stop = merged(v >> 32, v & 0xFFFFFFFF)
                    n, gone = len(start), int((stop - start).sum())
                    edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(raw)]
                    rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                digest = hashlib.sha256(rest).hexdigest()
                kept = rest.decode("utf-8", "ignore") if as_text else rest
                for have, new in zip(out, (kept, len(raw), gone, n, digest), strict=True):
                    have.append(new)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(out[0], pa.string() if as_text else pa.binary()), *[pa.array(c, pa.int64()) for c in out[1:4]], pa.array(out[4], pa.string())],
                names=[*batch.schema.names[:-2], "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return marked.mapInArrow(run, types + f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
