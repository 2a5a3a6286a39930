"""Near copies by wide SimHash fingerprints, deletion-variant signatures and exact similarity.

Two documents are linked if at least 0.8 of their distinct five-word shingles are common to both
(Jaccard). At that similarity a SimHash differs in up to 15 % of its bits, so 64 bits cannot both
find the pair and tell it from others. Here a fingerprint has 27 segments of 24 bits and three
more words. Documents that agree on one segment but for one bit at most are candidates: at a
similarity of 0.8 that holds for 95 % of the pairs, at 0.85 for 99 %, and for all that differ in
at most 53 of the 648 bits.

A segment that differs in one bit has a half that does not differ. So rows are dealt by half
segments (54 a document instead of 648 variants), and a task wipes each bit of the other half
itself. In a group of equal signatures a breadth-first search joins what is near by the three
other words and gives the edges of its tree, never all pairs; a group of copies takes one pass.

Candidates are then compared exactly, each document first with the nearest smaller id; edges
inside the groups that this confirms need no comparison, all others are compared too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import materialise

from . import groups
from .components import components
from .simhash import majority
from .workers import kept

WORDS = 5
SEGMENTS, BITS, HALF = 27, 24, 12
SKETCH = 3  # words of 64 bits beyond the segments
WIDE = 11 + SKETCH  # 27 segments fill less than 11 words
# Of the sketch's 192 bits, 29 differ on average at a similarity of 0.8, with a deviation of 5.
MAX_BITS = 44
PIECE = 4 << 20
BLOCK = 200_000


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, ws)), ">u8").astype(np.uint64)
    size = min(words, len(ws))
    total = np.zeros(len(ws) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(total)]
    return np.unique(mixed(total))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``WIDE`` words for each set of shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.stack([majority(mixed(values + np.uint64((w + 1) * 0xD1342543DE82EF95 % 2**64)), sizes) for w in range(WIDE)], 1)


def print_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None)
        for batch in batches:
            ids, texts = batch.columns
            prints, sets, digests, counts, held = [], [], [], [], 0
            for x in texts:
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                own = shingles(raw, words)
                sets.append(own)
                counts.append(len(own))
                digests.append(md5(b" ".join(raw.lower().split())).digest())
                held += len(raw)
                if held > PIECE:
                    prints.append(wide_prints(sets))
                    sets, held = [], 0
            prints.append(wide_prints(sets))
            rows = np.ascontiguousarray(np.concatenate(prints)).tobytes()
            wide = pa.array([rows[i : i + 8 * WIDE] for i in range(0, len(rows), 8 * WIDE)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), wide],
                names=["doc_id", "digest", "size", "wide"],
            )

    return run


SIGNED = "key long, other int, size int, node long, " + ", ".join(f"w{i} long" for i in range(SKETCH))


def sign():
    """Two rows a segment: a half as part of the key, and the other half."""
    schema = groups.schema_of(SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                node, size = batch.column("node").to_numpy(), batch.column("size").to_numpy()
                prints = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE)
                bits = np.unpackbits(prints[:, :11].copy().view(np.uint8), axis=1)[:, : SEGMENTS * BITS]
                halves = bits.reshape(len(node), 2 * SEGMENTS, HALF) @ (1 << np.arange(HALF))
                number = np.arange(2 * SEGMENTS)
                columns = {
                    "key": ((number << HALF) + halves).ravel(),
                    "other": halves[:, number ^ 1].ravel(),
                    "size": np.repeat(size, 2 * SEGMENTS),
                    "node": np.repeat(node, 2 * SEGMENTS),
                } | {f"w{i}": np.repeat(prints[:, 11 + i].copy().view(np.int64), 2 * SEGMENTS) for i in range(SKETCH)}
                yield from groups.as_batches(columns, None, schema)

    return run


class Rows:
    """Rows of some groups: number of the group, other half, sketch, size and node."""

    def __init__(self, run: np.ndarray, table: pa.Table):
        self.node = table.column("node").to_numpy()
        self.size = table.column("size").to_numpy().astype(np.int64)
        self.sketch = np.stack([table.column(f"w{i}").to_numpy().view(np.uint64) for i in range(SKETCH)], 1)
        self.code = (run.astype(np.int64) << HALF) | table.column("other").to_numpy()
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []

    def near(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        differ = np.bitwise_count(self.sketch[a] ^ self.sketch[b]).sum(-1, dtype=np.int64)
        x, y = self.size[a], self.size[b]
        # at a similarity of 0.8 one set is at least 0.8 of the other in size
        return (differ <= MAX_BITS) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)), differ

    def add(self, a, b) -> np.ndarray:
        hit, differ = self.near(a, b)
        if hit.any():
            self.left.append(np.broadcast_to(a, hit.shape)[hit])
            self.right.append(b[hit])
            self.bits.append(differ[hit])
        return hit

    def forest(self, at: np.ndarray) -> None:
        """Edges of trees over the near rows among ``at``; each row meets what no tree has reached."""
        left = at
        while len(left) > 1:
            front, left = deque(left[:1]), left[1:]
            while front and len(left):
                hit = self.add(front.popleft(), left)
                front.extend(left[hit])
                left = left[~hit]

    def join(self, keys: np.ndarray, at: np.ndarray, bit: int | None) -> None:
        """Links among the rows ``at`` of equal ``keys``; with ``bit``, only where that bit differs in a run."""
        order = np.lexsort((self.node[at], keys))
        at, keys = at[order], keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        wanted = sizes > 1
        if bit is not None and len(starts):
            ones = np.add.reduceat((self.code[at] >> bit) & 1, starts)
            wanted &= (ones > 0) & (ones < sizes)
        pairs = starts[wanted & (sizes == 2)]
        if len(pairs):
            self.add(at[pairs], at[pairs + 1])
        more = wanted & (sizes > 2)
        for s, n in zip(starts[more], sizes[more], strict=True):
            self.forest(at[s : s + n])

    def links(self) -> dict:
        every = np.arange(len(self.code))
        self.join(self.code, every, None)
        for bit in range(HALF):
            self.join(self.code & ~(1 << bit), every, bit)
        if not self.left:
            return {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "bits": np.zeros(0, np.int64)}
        x, y = self.node[np.concatenate(self.left)], self.node[np.concatenate(self.right)]
        found = np.stack([np.minimum(x, y), np.maximum(x, y), np.concatenate(self.bits)], 1)
        found = np.unique(found[x != y], axis=0)
        return {c: np.ascontiguousarray(found[:, i]) for i, c in enumerate(("a", "b", "bits"))}


def within(starts: np.ndarray, chunk: pa.Table) -> dict:
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(chunk))))
    return Rows(run, chunk).links()


def across(one: pa.Table, two: pa.Table) -> dict:
    return within(np.zeros(1, np.int64), pa.concat_tables([one, two]).combine_chunks())


def confirm(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            hits = []
            for i, (a, x, y) in enumerate(zip(*(batch.column(c) for c in ("a", "a_text", "b_text")), strict=True)):
                if own is None or a != last:
                    last, own = a, shingles(x.as_buffer().to_pybytes(), words)
                other = shingles(y.as_buffer().to_pybytes(), words)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 5 * common >= 4 * (len(own) + len(other) - common):
                    hits.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(hits, pa.int32())) for c in ("a", "b")], names=["a", "b"]
            )

    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar; ``texts`` has (node, text)."""
    first = texts.select(F.col("node").alias("a_node"), F.col("text").alias("a_text"))
    second = texts.select(F.col("node").alias("b_node"), F.col("text").alias("b_text"))
    both = pairs.join(second, F.col("b") == F.col("b_node")).join(first, F.col("a") == F.col("a_node"))
    return both.select("a", "b", "a_text", "b_text").mapInArrow(confirm(words), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs`` with an id.

    ``component_id`` is the smallest id reachable by links, its own included. Texts with the same
    words (A-Z lower-cased) are linked, so are all texts without words (null, empty, blank). Rows
    that share an id are one document and link what any of their texts links; so are repeated
    rows. Empty input gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.filter("doc_id is not null")
    prints = materialise(own.mapInArrow(print_batches(words), "doc_id long, digest binary, size int, wide binary"), "prints")
    classes = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "wide")).alias("r"))
    nodes = materialise(classes.select("digest", F.col("r.doc_id").alias("node"), "r.size", "r.wide"), "nodes")

    signed = nodes.filter("size > 0").select("node", "size", "wide").mapInArrow(sign(), SIGNED)
    found = groups.compare(signed, "key", within, across, "a long, b long, bits long", block=BLOCK, tag="candidates")
    edges = materialise(found.distinct(), "edges")

    # one text a node; of an id with several texts, each is held against the other end
    ends = edges.select(F.col("a").alias("end")).union(edges.select(F.col("b").alias("end"))).distinct()
    texts = materialise(
        own.join(ends, F.col("doc_id") == F.col("end"), "left_semi").select(F.col("doc_id").alias("node"), "text").distinct(), "texts"
    )
    # equal words under several ids, and several texts under one id
    same = prints.select("doc_id", "digest").join(nodes.select(F.col("digest").alias("d"), "node"), F.col("digest") == F.col("d"))
    same = materialise(same.select("doc_id", "node"), "same")

    best = edges.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("n")).select(F.col("n.a").alias("a"), "b")
    sure = materialise(verified(best, texts, words).distinct(), "sure")
    named = materialise(components(sure, "sure"), "named")
    of_a = named.select(F.col("node").alias("na"), F.col("root").alias("ra"))
    of_b = named.select(F.col("node").alias("nb"), F.col("root").alias("rb"))
    rest = (
        edges.join(of_a, F.col("a") == F.col("na"), "left")
        .join(of_b, F.col("b") == F.col("nb"), "left")
        .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        .select("a", "b")
    )
    tried = best.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    rest = rest.join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    more = verified(rest, texts, words)
    # a node with several ids' rows: an id's texts hang together through the id itself
    tied = same.filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    linked = materialise(sure.unionByName(more).unionByName(tied).distinct(), "links")
    placed = components(linked, "copies").select("node", "root")
    ids = prints.select("doc_id")
    return ids.join(placed, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("component_id")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their component; all columns, in order.

    Rows without an id cannot be named and stay.
    """
    found = near_copies(docs, id_col, text_col, words)
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
