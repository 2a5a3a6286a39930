"""Pipelines of named steps, and a store of results that later pipelines start from.

The store is a folder of Parquet tables that are only appended to: ``entries``, ``inputs``,
``hits`` and ``removed``; the current catalog is a query over them. Results lie beside them.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checks import require
from .catalog import evict_candidates, stale_entries
from .identity import function_identity
from .plans import SCAN, SCHEMA
from .trees import Node, rewrite, tree

GIB = 1024.0**3
_ENTRIES = (
    "id string, prefix string, steps int, path string, mtime bigint, size_gib double, "
    "ms bigint, n_nodes int, n_scans int, inserted timestamp"
)
_INPUTS = "id string, path string, mtime bigint, root string"
_IDS = "id string"


@dataclass(frozen=True)
class Step:
    op: str
    fn: str
    apply: Callable[[DataFrame], DataFrame]


class Pipeline:
    """A Parquet scan followed by named steps, each a function of a DataFrame."""

    def __init__(self, spark: SparkSession, job_id: str, inputs: Sequence[str], steps: Sequence[Step] = ()) -> None:
        self.spark, self.job_id = spark, job_id
        self.inputs, self.steps = list(inputs), list(steps)

    def then(self, op: str, f: Callable[[DataFrame], DataFrame], fn: str | None = None) -> Pipeline:
        """Add a step. ``fn`` names what it does; without it the function's code does."""
        step = Step(op, fn if fn is not None else function_identity(f), f)
        return Pipeline(self.spark, self.job_id, self.inputs, [*self.steps, step])

    def input_files(self) -> DataFrame:
        """(path, mtime): every input file and its modification time in ms; no content is read."""
        files = self.spark.read.format("binaryFile").load(self.inputs)
        return files.select("path", F.unix_millis("modificationTime").alias("mtime"))

    def nodes(self) -> DataFrame:
        """The plan as rows of ``plan_nodes``."""
        listed = F.array_sort(F.collect_list(F.struct("path", "mtime")))
        scan = self.input_files().agg(listed.alias("files")).select(
            F.lit(self.job_id).alias("job_id"),
            F.lit(0).alias("pos"),
            F.lit(SCAN).alias("op"),
            F.lit("").alias("fn"),
            F.transform("files", lambda f: f["path"]).alias("inputs"),
            F.transform("files", lambda f: f["mtime"]).alias("mtimes"),
        )
        rest = [(self.job_id, i + 1, s.op, s.fn, [], []) for i, s in enumerate(self.steps)]
        return scan.unionByName(self.spark.createDataFrame(rest, SCHEMA))

    def prefix(self, steps: int) -> str:
        """Digest of the scan and the first ``steps`` steps, to the letter."""
        parts = [sorted(self.inputs), [(s.op, s.fn) for s in self.steps[:steps]]]
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def run(self, steps: int | None = None, source: DataFrame | None = None, skip: int = 0) -> DataFrame:
        df = self.spark.read.parquet(*self.inputs) if source is None else source
        for step in self.steps[skip:steps]:
            df = step.apply(df)
        return df


class ResultStore:
    def __init__(self, spark: SparkSession, root: str, capacity_gib: float = float("inf")) -> None:
        self.spark, self.root, self.capacity = spark, root.rstrip("/"), capacity_gib

    # --- tables ---------------------------------------------------------------------
    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self._append_table(name, self.spark.createDataFrame(rows, schema).coalesce(1))

    def _append_table(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def catalog(self) -> DataFrame:
        """One row per stored result with its number of hits."""
        hits = self._table("hits", _IDS).groupBy("id").agg(F.count(F.lit(1)).alias("reuse"))
        live = self._table("entries", _ENTRIES).join(self._table("removed", _IDS), "id", "left_anti")
        return live.join(hits, "id", "left").withColumn("reuse", F.coalesce("reuse", F.lit(0)))

    # --- storing ----------------------------------------------------------------------
    def store(self, pipeline: Pipeline, steps: int | None = None, now: datetime | None = None) -> DataFrame:
        """Run the first ``steps`` steps, keep the result and return it read from the store."""
        steps = len(pipeline.steps) if steps is None else steps
        files = pipeline.input_files().withColumn("root", F.lit(None).cast("string"))
        path = self._keep(pipeline.run(steps), pipeline.prefix(steps), steps, files, steps + 1, 1, now)
        return self.spark.read.parquet(path)

    def store_frame(self, df: DataFrame, now: datetime | None = None) -> DataFrame:
        """Run any DataFrame, keep its rows under the digest of its plan and return them.

        Raises when the plan has no digest: it reads more than files, or holds random values,
        subqueries or functions without a stable identity.
        """
        node = tree(df)
        require(node.digest is not None, "the plan has no reliable identity, so its result could never be found")
        named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # a join's columns may share names
        files = files_under(self.spark, node.roots)
        scans = sum(not n.children for n in node.post_order())
        path = self._keep(named, node.digest, 0, files, node.nodes, scans, now)
        return self.spark.read.schema(named.schema).parquet(path).toDF(*df.columns)

    def _keep(
        self, df: DataFrame, prefix: str, steps: int, files: DataFrame, n_nodes: int, n_scans: int, now: datetime | None
    ) -> str:
        entry = uuid.uuid4().hex
        path = f"{self.root}/results/{entry}"
        # noted before the run: a file that changes meanwhile makes the entry stale, not wrong
        self._append_table("inputs", files.select(F.lit(entry).alias("id"), "path", "mtime", "root"))
        started = time.monotonic()
        df.write.parquet(path)
        elapsed = int((time.monotonic() - started) * 1000)
        written = self.spark.read.format("binaryFile").load(path)
        size, mtime = written.agg(
            F.coalesce(F.sum("length"), F.lit(0)), F.max(F.unix_millis("modificationTime"))
        ).first()
        size_gib = size / GIB
        now = now or datetime.now()
        try:
            self.make_room(size_gib, now)
        except ValueError:
            self._delete(path)
            raise
        self._append("entries", [(entry, prefix, steps, path, mtime, size_gib, elapsed, n_nodes, n_scans, now)], _ENTRIES)
        return path

    def make_room(self, needed_gib: float, now: datetime) -> list[str]:
        """Remove entries until ``needed_gib`` fit; returns the removed ids."""
        if self.capacity == float("inf"):
            return []
        victims = evict_candidates(self.catalog(), self.capacity, needed_gib, now)
        rows = victims.select("id", "path").collect()  # one small row per evicted result
        if rows:
            self._append("removed", [(row["id"],) for row in rows], _IDS)
        for row in rows:
            self._delete(row["path"])
        return [row["id"] for row in rows]

    def _delete(self, path: str) -> None:
        require(path.startswith(f"{self.root}/results/"), f"{path} is outside the store")
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

    # --- reading ----------------------------------------------------------------------
    def find(self, pipeline: Pipeline) -> tuple[str, str, int] | None:
        """(id, path, steps) of the longest stored prefix whose inputs are unchanged."""
        wanted = {pipeline.prefix(n): n for n in range(len(pipeline.steps) + 1)}
        candidates = self.catalog().filter(F.col("prefix").isin(list(wanted)))
        files = pipeline.input_files()
        stored = self._table("inputs", _INPUTS).join(candidates.select("id"), "id", "left_semi")
        stale = stale_entries(stored, files)
        grown = (
            stored.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != files.count())
        )
        usable = candidates.join(stale, "id", "left_anti").join(grown.select("id"), "id", "left_anti")
        best = usable.orderBy(F.col("steps").desc(), F.col("inserted").desc(), "id").first()
        return None if best is None else (best["id"], best["path"], best["steps"])

    def run(self, pipeline: Pipeline) -> DataFrame:
        """The pipeline's result, starting from a stored prefix when there is one."""
        found = self.find(pipeline)
        if found is None:
            return pipeline.run()
        entry, path, steps = found
        self._append("hits", [(entry,)], _IDS)
        return pipeline.run(source=self.spark.read.parquet(path), skip=steps)

    def find_parts(self, node: Node) -> dict[str, tuple[str, str]]:
        """Digest -> (id, path) of the stored parts of a plan whose files are unchanged."""
        parts = {n.digest: n for n in node.post_order() if n.digest is not None}
        latest = (
            self.catalog()
            .filter(F.col("prefix").isin(list(parts)))
            .groupBy("prefix")
            .agg(F.max_by(F.struct("id", "path"), F.struct("inserted", "id")).alias("e"))
        )
        found = {row["prefix"]: (row["e"]["id"], row["e"]["path"]) for row in latest.collect()}  # at most one a node
        if not found:
            return {}
        needs = [(entry, root) for digest, (entry, _) in found.items() for root in set(parts[digest].roots)]
        if needs:
            roots = self.spark.createDataFrame(needs, "id string, root string")
            current = files_under(self.spark, sorted({r for _, r in needs})).join(F.broadcast(roots), "root")
            stored = self._table("inputs", _INPUTS).join(roots.select("id").distinct(), "id", "left_semi")
            was = stored.select("id", "root", "path", F.col("mtime").alias("was"))
            other = was.join(current, ["id", "root", "path"], "full").filter(~F.col("was").eqNullSafe(F.col("mtime")))
            changed = {row["id"] for row in other.select("id").distinct().collect()}
            found = {d: e for d, e in found.items() if e[0] not in changed}
        return found

    def run_frame(self, df: DataFrame) -> DataFrame:
        """``df``, with the largest stored parts of its plan read from the store."""
        node = tree(df)
        found = self.find_parts(node)
        if not found:
            return df
        result, used = rewrite(self.spark, node, {digest: path for digest, (_, path) in found.items()})
        self._append("hits", [(found[digest][0],) for digest in used], _IDS)
        return result


def files_under(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(root, path, mtime): every file below each root and its time in ms; no content is read."""
    tables = [
        spark.read.format("binaryFile")
        .load(root)
        .select(F.lit(root).alias("root"), "path", F.unix_millis("modificationTime").alias("mtime"))
        for root in sorted(set(roots))
    ]
    empty = spark.createDataFrame([], "root string, path string, mtime bigint")
    return reduce(DataFrame.unionByName, tables, empty)


def frame_nodes(df: DataFrame, job_id: str) -> DataFrame:
    """The plan of any DataFrame as rows of ``plan_nodes``, in post-order.

    A scan's ``inputs`` are its files, those of other steps are empty; ``fn`` is the digest of
    the plan up to a step, or, where it has none, unlike any other.
    """
    spark = df.sparkSession
    rows = []
    for pos, node in enumerate(tree(df).post_order()):
        scan = not node.children
        fn = "" if scan and node.roots else node.digest or uuid.uuid4().hex
        rows.append((job_id, pos, SCAN if scan else node.op, fn, list(node.roots) if scan else []))
    steps = spark.createDataFrame(rows, "job_id string, pos int, op string, fn string, roots array<string>")
    files = files_under(spark, [r for *_, roots in rows for r in roots])
    listed = (
        steps.select("pos", F.explode("roots").alias("root"))
        .join(files, "root")
        .groupBy("pos")
        .agg(F.array_sort(F.collect_list(F.struct("path", "mtime"))).alias("files"))
    )
    held = F.coalesce("files", F.array().cast("array<struct<path: string, mtime: bigint>>"))
    return steps.join(listed, "pos", "left").select(
        "job_id", "pos", "op", "fn", F.transform(held, lambda f: f["path"]).alias("inputs"),
        F.transform(held, lambda f: f["mtime"]).alias("mtimes"),
    )
