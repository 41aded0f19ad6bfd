"""Merkle manifest of a dataset: one digest per row, a tree per source, a tree of sources.

Every row is a leaf. The leaves of a source, in doc_id order, are hashed in runs of 16 until
one node is left (the source's subroot), and the subroots, in source order, likewise give
the root. H is the lowercase hex SHA-256 of the joined inputs; digests enter as hex text.

Checkpoint and recompute: of a tree only every third level is written. An *aligned
subtree* is what lies between two written levels, at most 16**3 nodes of the lower one,
and is the unit of work: one group of a shuffle by (tree, subtree), so a source of any size
is spread over the cluster. On the way up a subtree is folded to its top node and its two
inner levels are dropped. On the way down they are regenerated from the written nodes
below, each node's siblings are emitted with those of the subtree's top, and they are dropped
again. Rows take their places in a source by range partitioning (``positions``).

Defined cases: a null column enters as ``-``, an empty text as ``0:``. A null source is a
source of its own, before all others; rows without a doc_id come first in their source.
Rows that share a doc_id are ordered by leaf, and equal rows are leaves of their own. A
source of one row has its leaf as subroot, a table of one source its subroot as root, and the
proof of a lone row is the digest of nothing. Empty tables give no row. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.operators.positions import positions
from tillroll.operators.scratch import materialize

RUN_BITS = 4
RUN = 1 << RUN_BITS
#: Levels from one written level to the next.
LEVELS = 3
SUBTREE_BITS = RUN_BITS * LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose decimal doc_id has a CRC-32 that this divides are tampered with.
TAMPER_MOD = 5

_NODE = "tree string, pos long, size long, digest string"
_PATH = "tree string, pos long, path string, subroot string, root string"
_ROW = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean, path string"
)


def leaf_digest(*values: Column) -> Column:
    """H of the values: each its UTF-8 length, a colon and itself, or ``-`` if null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row after tampering (A-Z of the text in lower case), null where the
    row is not tampered with."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = [lower if c == "text" else F.col(c) for c in COLUMNS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MOD == 0
    return F.when(chosen, leaf_digest(*values))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def inner_levels(digests: list[str], size: int) -> list[list[str]]:
    """The levels of an aligned subtree, from its lowest nodes to its top node.

    ``size`` counts the nodes of the whole tree at the lowest of these levels; the tree
    ends where one node is left.
    """
    found = [digests]
    for _ in range(LEVELS):
        if size == 1:
            break
        below = found[-1]
        found.append([_hash("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
        size = -(-size // RUN)
    return found


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Per level below the top, what stands left and right of node ``at`` of the lowest
    level, or of the node above it, in its run."""
    found = []
    for level in levels[:-1]:
        run = at // RUN * RUN
        found.append(("".join(level[run:at]), "".join(level[at + 1 : run + RUN])))
        at //= RUN
    return found


def as_text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in path)


def from_text(path: str) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in path.split(";")] if path else []


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        digest = _hash(left + digest + right)
    return digest


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("pos").to_numpy(), kind="stable")))


def _top(table: pa.Table) -> pa.Table:
    """The top node of one aligned subtree; its inner levels are not kept."""
    table = _in_order(table)
    tree, size = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
    levels = inner_levels(table.column("digest").to_pylist(), size)
    for _ in levels[1:]:
        size = -(-size // RUN)
    pos = table.column("pos")[0].as_py() >> SUBTREE_BITS
    return pa.table({"tree": [tree], "pos": [pos], "size": [size], "digest": levels[-1]})


@dataclass(frozen=True)
class Forest:
    """The written levels of all trees, lowest first, each (tree, pos, size, digest)."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest) of the last node of every tree."""
        done = [level.where("size = 1").select("tree", "digest") for level in self.levels]
        whole = done[0]
        for more in done[1:]:
            whole = whole.unionByName(more)
        return whole


def build(leaves: DataFrame) -> Forest:
    """Trees over ``leaves`` (tree, pos, size, digest, further columns stay on this level)."""
    levels = [leaves]
    # A level has at most a 16**3 th of the nodes below it, or one per tree.
    while levels[-1].where("size > 1").limit(1).count():
        rest = levels[-1].where("size > 1").select("tree", "pos", "size", "digest")
        subtree = F.shiftright("pos", SUBTREE_BITS).alias("subtree")
        levels.append(materialize(rest.groupBy("tree", subtree).applyInArrow(_top, _NODE), "level"))
    return Forest(levels)


def _node_paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of the nodes of one aligned subtree, given that of its top node."""
    if not len(nodes):
        return pa.table({k: [] for k in ("tree", "pos", "path", "subroot", "root")}, _arrow_schema(_PATH))
    nodes, top = _in_order(nodes), above.to_pylist()[0]
    levels = inner_levels(nodes.column("digest").to_pylist(), nodes.column("size")[0].as_py())
    path = [as_text(siblings(levels, at)) for at in range(len(nodes))]
    return pa.table(
        {
            "tree": nodes.column("tree"),
            "pos": nodes.column("pos"),
            "path": [";".join(filter(None, (p, top["path"]))) for p in path],
            "subroot": [top["subroot"]] * len(nodes),
            "root": [top["root"]] * len(nodes),
        },
        _arrow_schema(_PATH),
    )


def _row_proofs(nodes: pa.Table, above: pa.Table, keep_paths: bool) -> pa.Table:
    """Proofs of the rows of one aligned subtree: its inner levels are regenerated, the
    siblings are hashed and folded, and everything but the digests is dropped."""
    names = pa.schema(_arrow_schema(_ROW))
    if not len(nodes):
        return names.empty_table()
    nodes, top = _in_order(nodes), above.to_pylist()[0]
    leaves, tampered = nodes.column("digest").to_pylist(), nodes.column("tampered").to_pylist()
    levels = inner_levels(leaves, nodes.column("size")[0].as_py())
    upper = from_text(top["path"])
    proofs, folded, paths = [], [], []
    run, shared, shared_text = -1, [], ""
    for at, (leaf, other) in enumerate(zip(leaves, tampered)):
        if at // RUN != run:  # the leaves of a run share all siblings but the lowest
            run = at // RUN
            shared = [*siblings(levels[1:], run), *upper]
            shared_text = "".join(left + right for left, right in shared)
        lowest = siblings(levels[:2], at)
        path = lowest + shared
        proofs.append(_hash("".join(left + right for left, right in lowest) + shared_text))
        folded.append(fold(leaf if other is None else other, path))
        paths.append(as_text(path) if keep_paths else None)
    return pa.table(
        {
            "doc_id": nodes.column("doc_id"),
            "leaf": leaves,
            "subroot": [top["subroot"]] * len(leaves),
            "root": [top["root"]] * len(leaves),
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == top["root"] for f in folded],
            "path": paths,
        },
        names,
    )


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _descend(forest: Forest, start: DataFrame, at_leaves, schema: str) -> DataFrame:
    """Carry paths from the roots (``start``: tree, path, subroot, root) to the leaves."""
    paths = None
    for depth in reversed(range(len(forest.levels))):
        nodes = forest.levels[depth]
        ends = nodes.where("size = 1").select("tree", "pos").join(start, "tree")
        ends = ends.select("tree", "pos", "path", "subroot", "root")
        # One row per aligned subtree; written, so that the groups below read two tables.
        above = materialize(ends if paths is None else paths.unionByName(ends), "tops")
        subtrees = nodes.groupBy("tree", F.shiftright("pos", SUBTREE_BITS).alias("subtree"))
        met = subtrees.cogroup(above.groupBy("tree", F.col("pos").alias("subtree")))
        if depth == 0:
            return met.applyInArrow(at_leaves, schema)
        paths = met.applyInArrow(_node_paths, _PATH)


def merkle_manifest(docs: DataFrame, keep_paths: bool = False) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``keep_paths`` adds ``path``, the siblings themselves: per level from the leaf up
    ``left,right``, the levels parted by ``;``.
    """
    docs = docs.select(*COLUMNS)
    leaves = materialize(
        docs.select(
            "doc_id",
            # a null source is the empty tree name, and so comes first
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("tree"),
            leaf_digest(*[F.col(c) for c in COLUMNS]).alias("digest"),
            tampered_leaf(docs).alias("tampered"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    order = [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("row")]
    sources = build(positions(leaves, ["tree"], order, "leaves-ordered"))
    subroots = materialize(sources.roots().withColumnRenamed("tree", "source_tree"), "subroots")
    listed = positions(subroots, [], [F.col("source_tree")], "subroots-ordered")
    top = build(listed.withColumn("tree", F.lit("")))
    root = top.roots().select("tree", "digest")
    # The path of a subroot is that of a leaf of the upper tree.
    at_root = root.select("tree", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    found = materialize(_descend(top, at_root, _node_paths, _PATH), "subroot-paths")
    start = (
        top.levels[0]
        .select("pos", "source_tree", "digest")
        .join(found, "pos")
        .select(F.col("source_tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    )
    rows = _descend(sources, materialize(start, "subroot-starts"), partial(_row_proofs, keep_paths=keep_paths), _ROW)
    return rows if keep_paths else rows.drop("path")
