"""Plans of any DataFrame as trees of digests, and DataFrames that start from stored parts of theirs.

A node's digest covers its operator, its expressions in canonical form, its schema and the
digests of the nodes below; a scan's covers its files' roots, format, schema and options. So two
DataFrames built in different places, with other aliases and column ids, have equal digests
where their plans are equal. What has no reliable text has no digest, and neither has anything
above it: local rows, subqueries, random values, functions of unknown identity.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame, SparkSession

from .identity import function_identity

# Operators whose canonical text says all that they do.
OPERATORS = frozenset(
    "Aggregate Deduplicate Distinct Except Expand Filter FlatMapGroupsInArrow FlatMapGroupsInPandas Generate GlobalLimit "
    "Intersect Join LocalLimit MapInArrow MapInPandas Offset Project RebalancePartitions Repartition "
    "RepartitionByExpression Sort Union Window".split()
)
# Operators that leave the rows as they are.
TRANSPARENT = frozenset(["SubqueryAlias", "ResolvedHint"])
# Settings that change what an expression means.
SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive", "spark.sql.legacy.timeParserPolicy")
TO_STRING = "spark.sql.debug.maxToStringFields"


@dataclass(frozen=True)
class Node:
    op: str
    text: str  # what the node does, without the nodes below
    digest: str | None
    nodes: int
    roots: tuple[str, ...]  # of all files below, by scan
    children: tuple[Node, ...]
    plan: Any

    def post_order(self) -> Iterator[Node]:
        for child in self.children:
            yield from child.post_order()
        yield self


def _items(sequence: Any) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _class(value: Any) -> str:
    return value.getClass().getSimpleName().rstrip("$")


def _functions(expression: Any) -> Iterator[str | None]:
    """Identities of the Python functions in an expression; None where one has none."""
    name = _class(expression)
    if name.startswith("Scala"):
        yield None
    elif name.startswith("Python"):
        try:
            command = bytes(int(b) & 255 for b in expression.func().command().mkString(",").split(","))
            f = CPickleSerializer().loads(command)
            yield function_identity(f[0] if isinstance(f, tuple) else f)
        except Exception:  # noqa: BLE001 - a function that cannot be read is unlike any other
            yield None
    for child in _items(expression.children()):
        yield from _functions(child)


def _expressions(canonical: Any) -> list | None:
    """Each expression as JSON, whose types the text leaves out, and its functions' identities."""
    told = []
    for e in _items(canonical.expressions()):
        identities = list(_functions(e))
        if None in identities:
            return None
        # the id of a process, and of a function's result, say nothing about the value
        text = re.sub(r'"(jvmId|resultId)":("[^"]*"|\{[^{}]*\})', "", e.toJSON())
        told.append([re.sub(r"#\d+", "#", text) if identities else text, identities])
    return told


def _scan_text(plan: Any) -> tuple[str, tuple[str, ...]] | None:
    """What a file scan reads, and the roots of its files."""
    relation = plan.relation()
    if _class(relation) != "HadoopFsRelation":
        return None
    roots = tuple(p.toString() for p in _items(relation.location().rootPaths()))
    options = sorted(str(o) for o in _items(relation.options().toSeq()))
    schemas = [relation.dataSchema().json(), relation.partitionSchema().json()]
    return json.dumps([sorted(roots), relation.fileFormat().getClass().getName(), options, schemas]), roots


def _node(plan: Any, settings: str) -> Node:
    op = _class(plan)
    children = tuple(_node(c, settings) for c in _items(plan.children()))
    nodes = 1 + sum(c.nodes for c in children)
    roots = tuple(r for c in children for r in c.roots)
    if op in TRANSPARENT:
        child = children[0]
        return Node(op, "", child.digest, nodes, roots, children, plan)
    text = None
    if not children:
        scan = _scan_text(plan) if op == "LogicalRelation" else None
        if scan is not None:
            text, roots = scan
        elif op == "Range":
            text = plan.canonicalized().toString()
    elif op in OPERATORS and plan.deterministic() and plan.subqueries().size() == 0:
        canonical = plan.canonicalized()
        told = _expressions(canonical)
        if told is not None:
            line = canonical.simpleString(2**31 - 1)
            if any(identities for _, identities in told):
                line = re.sub(r"#\d+", "#", line)  # numbers of functions' results
            text = json.dumps([line, told])
    known = text is not None and all(c.digest is not None for c in children)
    digest = None
    if known:
        parts = [op, text, plan.schema().json(), settings, [c.digest for c in children]]
        digest = hashlib.sha256(json.dumps(parts).encode()).hexdigest()
    return Node(op, text or "", digest, nodes, roots, children, plan)


def tree(df: DataFrame) -> Node:
    """The plan of ``df`` as written, with a digest for every part that has one."""
    spark = df.sparkSession
    before = spark.conf.get(TO_STRING)
    spark.conf.set(TO_STRING, str(2**31 - 1))  # no text may be cut
    try:
        settings = json.dumps([spark.conf.get(s, None) for s in SETTINGS])
        return _node(df._jdf.queryExecution().analyzed(), settings)
    finally:
        spark.conf.set(TO_STRING, before)


def rewrite(spark: SparkSession, node: Node, stored: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """The node's DataFrame, reading the largest parts whose digest is in ``stored`` from there.

    ``stored`` maps digests to Parquet folders with columns ``c0``, ``c1`` and so on. Also the
    digests that are used, one for each place.
    """
    jvm = spark._jvm
    used: list[str] = []

    def sequence(items: list) -> Any:
        return jvm.PythonUtils.toSeq(items)

    def read(part: Node) -> Any:
        source = spark.read.parquet(stored[part.digest])._jdf.queryExecution().analyzed()
        column = {a.name(): a for a in _items(source.output())}
        expressions = jvm.org.apache.spark.sql.catalyst.expressions
        none = getattr(jvm.scala, "None$").__getattr__("MODULE$")
        # the stored columns take the ids that the nodes above know
        named = [
            expressions.Alias(column[f"c{i}"], a.name(), a.exprId(), sequence([]), none, sequence([]))
            for i, a in enumerate(_items(part.plan.output()))
        ]
        return jvm.org.apache.spark.sql.catalyst.plans.logical.Project(sequence(named), source)

    def build(part: Node) -> Any:
        if part.digest in stored:
            used.append(part.digest)
            return read(part)
        children = [build(c) for c in part.children]
        if all(new is c.plan for new, c in zip(children, part.children, strict=True)):
            return part.plan
        return part.plan.withNewChildren(sequence(children))

    plan = build(node)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark), used
