"""Merkle manifest of a dataset, with the proofs of all its rows from octopus multiproofs.

Rows are leaves of one tree per value of a column; the roots of these trees are the leaves of a
last tree. Every ``ARITY`` consecutive nodes become one, whose digest is the SHA-256 of theirs
as hex text; a last run may be shorter, even a single node. Work is by blocks of ``BLOCK``
consecutive leaves:

1. Leaves are sorted by range partitions and written; a position is that of the file plus that
   in it, so a tree of any size is numbered without one task holding it.
2. A block is reduced to one node in a task, the blocks' nodes are blocked again, and so on.
3. Octopus multiproof: each leaf partition (a block, or what is asked of it) computes the
   least set of node coordinates that its proofs need beyond what follows from its own leaves,
   fetches them all by one join, derives the interiors that its proofs share once, and expands
   the proofs from them.

Digests are joined and written, never texts, and a task holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import require
from ..plans.keys import cols, quoted
from ..plans.prefix import FILE, ROW, numbered_files, with_position
from ..plans.shared import materialise
from ..plans.skew import broadcast_if_small
from .groups import schema_of

ARITY = 8
# Levels that a block of leaves is reduced by at once, and its leaves.
LEVELS = 4
BLOCK = ARITY**LEVELS
# Proofs handed over at once.
ROWS = 1024
STEPS = "array<struct<before: string, after: string>>"


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: SHA-256 of ``-`` for null, else byte count, ``:``, value, of each column."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def parent(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def above(n: int) -> int:
    return -(-n // ARITY)


def missing(positions: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(level, node numbers) that the proofs of these leaves need and their own nodes do not give.

    ``positions`` are sorted and distinct. A node is left out when it is one of the leaves or an
    ancestor of one, since the ancestors are derived on the way up.
    """
    needed, have, level = [], positions, 0
    while size > 1:
        parents = np.unique(have // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        needed.append((level, np.setdiff1d(children[children < size], have, assume_unique=True)))
        have, size, level = parents, above(size), level + 1
    return needed


def derive(
    positions: list[int], digests: list[str], size: int, fetched: dict[tuple[int, int], str]
) -> tuple[list[dict[int, str]], str]:
    """Per level, the joined digests of each run that a proof passes; and the root."""
    runs, have = [], dict(zip(positions, digests, strict=True))
    while size > 1:
        level, joined = len(runs), {}
        for p in dict.fromkeys([i // ARITY for i in have]):
            members = range(p * ARITY, min(p * ARITY + ARITY, size))
            joined[p] = "".join([have[i] if i in have else fetched[level, i] for i in members])
        runs.append(joined)
        have, size = {p: parent(text) for p, text in joined.items()}, above(size)
    return runs, have[0]


def expand(position: int, runs: list[dict[int, str]]) -> list[tuple[str, str]]:
    """The proof of a leaf: what stands before and after it, or its ancestor, in each run."""
    steps, width = [], 64
    for joined in runs:
        position, k = divmod(position, ARITY)
        text = joined[position]
        steps.append((text[: k * width], text[(k + 1) * width :]))
    return steps


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof, both as hex text."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass(frozen=True)
class Forest:
    """Trees numbered from 0: their leaves in blocks, their nodes, their roots."""

    blocks: DataFrame  # tree, size, block, rows: array<struct<pos, digest, …>>
    nodes: DataFrame  # tree, size, level, idx, digest
    roots: DataFrame  # tree, size, root


def block_rows(leaves: DataFrame) -> DataFrame:
    """Blocks of the leaves (tree, size, pos, digest, …), each a row with its leaves in order."""
    others = [c for c in leaves.columns if c not in ("tree", "size")]
    held = F.array_sort(F.collect_list(F.struct(*cols(others))))
    return leaves.groupBy("tree", "size", F.floor(F.col("pos") / BLOCK).alias("block")).agg(held.alias("rows"))


def _raw(texts: list[str]) -> pa.Array:
    return pa.array([bytes.fromhex(t) for t in texts], pa.binary())


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, pa.Array]]:
    """(batch, row, leaves as a struct array) of each block."""
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index("rows"))
        for i in range(batch.num_rows):
            yield batch, i, rows[i].values


def _hexes(digests: pa.Array) -> list[str]:
    return [d.hex() for d in digests.to_pylist()]


def reduce_blocks(blocks: DataFrame, level: int) -> DataFrame:
    """(tree, size, level, idx, digest): the nodes over blocks of nodes of one level.

    A block goes up as many levels as a full one needs to become one node, or to its root when
    it is the whole level.
    """
    ddl = "tree long, size long, level int, idx long, digest binary"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, rows in _blocks_of(batches):
            tree, size = batch.column("tree")[i].as_py(), batch.column("size")[i].as_py()
            count = size
            for _ in range(level):
                count = above(count)
            position, digest = rows.flatten()[:2]
            digests, first = _hexes(digest), position[0].as_py()
            for up in range(1, LEVELS + 1):
                if count == 1:
                    break
                digests = [parent("".join(digests[k : k + ARITY])) for k in range(0, len(digests), ARITY)]
                count, first = above(count), first // ARITY
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, tree)), pa.array(np.full(n, size)),
                        pa.array(np.full(n, level + up, np.int32)), pa.array(np.arange(first, first + n)), _raw(digests),
                    ],
                    schema=schema,
                )

    return blocks.select("tree", "size", "rows").mapInArrow(run, ddl)


def grow(leaves: DataFrame) -> Forest:
    """The forest over leaves (tree, size, pos, digest, …): positions are gapless from 0."""
    blocks = materialise(block_rows(leaves), "blocks")
    bottom = leaves.select("tree", "size", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
    largest = blocks.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    levels, level, todo = [bottom], 0, blocks
    while largest > 1:
        made = materialise(reduce_blocks(todo, level), "nodes")
        levels.append(made)
        largest, level = -(-largest // BLOCK), level + LEVELS
        count = F.ceil(F.col("size") / F.lit(float(ARITY**level)))
        ends = made.filter((F.col("level") == level) & (count > 1))
        todo = block_rows(ends.select("tree", "size", F.col("idx").alias("pos"), "digest"))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    alone = F.ceil(F.col("size") / F.pow(F.lit(float(ARITY)), "level")) == 1
    roots = nodes.filter(alone).select("tree", "size", F.col("digest").alias("root"))
    return Forest(blocks, nodes, materialise(roots, "roots"))


def wanted_nodes(blocks: DataFrame) -> DataFrame:
    """(tree, block, level, idx): for each leaf partition, the nodes that it has to fetch."""
    ddl = "tree long, block long, level int, idx long"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, sizes, numbers, places = (batch.column(n) for n in ("tree", "size", "block", "places"))
            for i in range(batch.num_rows):
                for level, idx in missing(np.unique(places[i].values.to_numpy()), sizes[i].as_py()):
                    n = len(idx)
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, trees[i].as_py())), pa.array(np.full(n, numbers[i].as_py())),
                                pa.array(np.full(n, level, np.int32)), pa.array(idx),
                            ],
                            schema=schema,
                        )

    places = F.transform("rows", lambda r: r["pos"])
    return blocks.select("tree", "size", "block", places.alias("places")).mapInArrow(run, ddl)


def prove(forest: Forest, blocks: DataFrame | None = None) -> DataFrame:
    """(tree, root, steps, …): the proof of every leaf, with the columns kept beside it.

    ``blocks`` are leaf partitions, by default the forest's; a block may hold any of its leaves.
    """
    blocks = forest.blocks if blocks is None else blocks
    found = (
        wanted_nodes(blocks)
        .join(forest.nodes.drop("size"), ["tree", "level", "idx"])
        .groupBy("tree", "block")
        .agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))
    )
    fields = [f for f in blocks.schema["rows"].dataType.elementType.fields]
    out = ["tree long", "root string", f"steps {STEPS}", "pos long", "digest binary"]
    ddl = ", ".join([*out, *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields[2:]]])
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, rows in _blocks_of(batches):
            columns = rows.flatten()
            places, size = columns[0].to_pylist(), batch.column("size")[i].as_py()
            nodes = batch.column("fetched")[i].as_py() or ()
            fetched = {(n["level"], n["idx"]): n["digest"].hex() for n in nodes}
            runs, root = derive(places, _hexes(columns[1]), size, fetched)
            depth = len(runs)
            for at in range(0, len(places), ROWS):
                steps = [s for p in places[at : at + ROWS] for s in expand(p, runs)]
                n = len(places[at : at + ROWS])
                pairs = pa.StructArray.from_arrays(
                    [pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())],
                    ["before", "after"],
                )
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * depth)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("tree")[i].as_py())), pa.array([root] * n),
                        pa.ListArray.from_arrays(offsets, pairs).cast(schema.field(2).type),
                        *[c.slice(at, n) for c in columns],
                    ],
                    schema=schema,
                )

    return blocks.join(found, ["tree", "block"], "left").mapInArrow(run, ddl)


@dataclass(frozen=True)
class Manifest:
    trees: Forest  # one tree per value
    top: Forest  # one tree, over the roots of the others
    tree_col: str
    names: dict[str, str]  # columns kept beside the leaves

    def proofs(self, blocks: DataFrame | None = None) -> DataFrame:
        """(value, …, leaf, subroot, root, steps): every leaf with its proof up to the one root."""
        upper = prove(self.top).select(
            F.col("pos").alias("__top"), F.col("root").alias("__root"), F.col("steps").alias("__more"), "value"
        )
        side = broadcast_if_small(materialise(upper, "subproofs"))  # one row per tree
        below = prove(self.trees, blocks).join(side, F.col("tree") == F.col("__top"))
        return below.select(
            F.col("value").alias(self.tree_col), *[F.col(n).alias(c) for c, n in self.names.items()],
            F.lower(F.hex("digest")).alias("leaf"), F.col("root").alias("subroot"), F.col("__root").alias("root"),
            F.concat("steps", "__more").alias("steps"),
        )


def manifest(leaves: DataFrame, tree_col: str, order_col: str, leaf_col: str) -> Manifest:
    """The manifest of a table of leaves; ``leaf_col`` is a digest as hex text.

    Leaves of a tree ascend by ``order_col``, nulls first, and by digest where it ties; trees
    ascend by value, null first, strings by their bytes. Repeated rows are leaves each. All other
    columns are kept beside the leaf and may have any name but ``leaf``, ``subroot``, ``root``
    and ``steps``, which ``proofs`` adds. Texts play no part: a leaf is a digest, however long
    what it stands for. An empty table has an empty manifest.
    """
    others = [c for c in leaves.columns if c not in (tree_col, leaf_col)]
    clash = {"leaf", "subroot", "root", "steps"}.intersection([*others, tree_col])
    require(not clash, f"columns {sorted(clash)} are added by the proofs")
    names = {c: f"k{i}" for i, c in enumerate(others)}
    value, digest, *kept = (F.col(quoted(c)) for c in [tree_col, leaf_col, *others])
    table = numbered_files(
        leaves.select(value.alias("value"), F.unhex(digest).alias("digest"), *[k.alias(n) for k, n in zip(kept, names.values())])
    ).withColumnsRenamed({FILE: "from_file", ROW: "from_row"})
    # the row's place spreads equal rows over ranges
    order = [F.col("value").asc_nulls_first(), F.col(names[order_col]).asc_nulls_first(), "digest", "from_file", "from_row"]
    placed, _ = with_position(table, order, "index")
    spans = placed.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("index").alias("first"))
    numbered, n_trees = with_position(spans, [F.col("value").asc_nulls_first()], "tree")
    trees = materialise(numbered, "trees")
    side = broadcast_if_small(trees.withColumnRenamed("value", "tree_value"))
    members = placed.join(side, F.col("value").eqNullSafe(F.col("tree_value"))).select(
        "tree", "size", (F.col("index") - F.col("first")).alias("pos"), "digest", *names.values()
    )
    below = grow(members)
    top = grow(
        below.roots.join(trees.select("tree", "value"), "tree").select(
            F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("pos"),
            F.col("root").alias("digest"), "value",
        )
    )
    return Manifest(below, top, tree_col, names)
