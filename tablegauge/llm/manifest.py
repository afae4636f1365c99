"""Merkle manifest of a dataset: subtrees stored in van Emde Boas order, block roots are the next leaves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Work

HEIGHT = 12  # levels of a block above its leaves: 4,096 leaves
DIGEST = 64  # bytes of a digest as hex text


class VebLayout:
    """Places of the nodes of a full binary tree of ``levels`` levels in van Emde Boas order.

    The tree is cut at half its height into a top tree and the bottom trees that hang from it, each
    stored on end and laid out in the same way. Per depth of a node three numbers are kept: the size of
    the top tree of the cut that makes its depth the first of a bottom tree, the size of these bottom
    trees, and the depth at which that top tree begins. With the number of a node in its level they
    give its place: the place of the top tree, behind it, and the bottom trees left of its own.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.size = (1 << levels) - 1
        self.top, self.bottom, self.root = ([0] * levels for _ in range(3))
        self._split(0, levels)

    def _split(self, root: int, levels: int) -> None:
        if levels < 2:
            return
        upper = levels // 2
        depth = root + upper
        self.top[depth] = (1 << upper) - 1
        self.bottom[depth] = (1 << levels - upper) - 1
        self.root[depth] = root
        self._split(root, upper)
        self._split(depth, levels - upper)

    def address(self, depth: int, index: np.ndarray) -> np.ndarray:
        """Places of the nodes number ``index`` (from 0) at ``depth`` (the root's is 0)."""
        place = np.zeros(len(index), np.int64)
        while depth:
            # The node's bottom tree among those of its top tree, then the root of that top tree.
            above = depth - self.root[depth]
            place += self.top[depth] + (index & (1 << above) - 1) * self.bottom[depth]
            index, depth = index >> above, self.root[depth]
        return place


@lru_cache(maxsize=64)
def layout(levels: int) -> VebLayout:
    return VebLayout(levels)


class Subtree:
    """The nodes over a run of leaves, ``height`` levels above them, in one array in van Emde Boas order.

    A node without a partner is hashed alone. Nodes that no leaf lies under stay empty.
    """

    def __init__(self, leaves: np.ndarray, height: int):
        self.layout, self.height = layout(height + 1), height
        self.counts = [len(leaves)]
        self.nodes = np.zeros(self.layout.size, f"S{DIGEST}")
        self.nodes[self.layout.address(height, np.arange(len(leaves)))] = leaves
        for depth in reversed(range(height)):
            n = -(-self.counts[-1] // 2)
            below = self.nodes[self.layout.address(depth + 1, np.arange(self.counts[-1]))].tolist()
            pairs = [sha256(b"".join(below[2 * i : 2 * i + 2])).hexdigest().encode() for i in range(n)]
            self.nodes[self.layout.address(depth, np.arange(n))] = pairs
            self.counts.append(n)

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[0])

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """Per leaf, from the leaves up, its siblings' digests (empty: none) and whether they are on the left."""
        n = self.counts[0]
        found, left = np.zeros((n, self.height), f"S{DIGEST}"), np.zeros((n, self.height), bool)
        for level, count in enumerate(self.counts[: self.height]):
            index = np.arange(n) >> level
            beside = index ^ 1
            there = beside < count
            found[there, level] = self.nodes[self.layout.address(self.height - level, beside[there])]
            left[:, level] = (index & 1).astype(bool)
        return found, left


def digest(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 of values on end: ``-`` for a null, else UTF-8 byte count, ``:`` and the value as text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _blocks(height: int):
    """The nodes of a block with the steps from each to the block's root."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        nodes = np.array(table["node"].to_pylist(), f"S{DIGEST}")
        # A tree within one block ends where one node is left.
        levels = min(height, (table["total"][0].as_py() - 1).bit_length())
        tree = Subtree(nodes, levels)
        found, left = (a.ravel() for a in tree.siblings())
        steps = pa.StructArray.from_arrays(
            [pa.array(found.astype(f"U{DIGEST}"), pa.string(), mask=found == b""), pa.array(left)], ["sibling", "left"],
        )
        offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * levels)
        table = table.append_column("steps", pa.ListArray.from_arrays(offsets, steps))
        table = table.append_column("block", pa.array(np.asarray(table["position"]) >> height))
        return table.append_column("root", pa.array([tree.root.decode()] * len(nodes)))

    return build


def _paths(work: Work, nodes: DataFrame, name: str, height: int) -> DataFrame:
    """``nodes`` (tree, position, total, node, ...) with the steps to the root of their tree, and that root."""
    if nodes.isEmpty():
        return nodes.selectExpr("*", f"cast(array() as {STEPS}) as steps", "node as root")
    schema = T.StructType([*nodes.schema.fields, *T._parse_datatype_string(f"steps {STEPS}, block bigint, root string").fields])
    blocks = nodes.groupBy("tree", F.shiftright("position", height).alias("of")).applyInArrow(_blocks(height), schema)
    blocks = work.write(blocks, name)
    if nodes.agg(F.max("total")).first()[0] <= 1 << height:
        return blocks.drop("block")
    # The block roots are the leaves of the same work one floor up.
    above = blocks.where(F.col("position") % (1 << height) == 0).select(
        "tree", F.col("block").alias("position"), F.expr(f"(total + {(1 << height) - 1}) div {1 << height}").alias("total"),
        F.col("root").alias("node"),
    )
    upper = _paths(work, above, f"{name}-up", height).select(
        "tree", F.col("position").alias("block"), F.col("steps").alias("further"), F.col("root").alias("top"),
    )
    joined = blocks.join(upper, ["tree", "block"])
    return joined.select(*nodes.columns, F.concat("steps", "further").alias("steps"), F.col("top").alias("root"))


def _placed(work: Work, df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's position within its group, and the group's size.

    The rows are cut into ranges, sorted and written with their place in the range, so no task holds a
    group; the rows before a range are summed from one row per range and group.
    """
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    ranged = work.write(ranged.withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33).alias("part")
    counts = ranged.groupBy(*groups, part).agg(F.min("row").alias("first"), F.count("*").alias("inside"))
    by = f"partition by {', '.join(groups)}" if groups else ""
    before = work.write(counts.selectExpr(
        *[f"{g} as of_{g}" for g in groups], "part", "first",
        f"sum(inside) over ({by} order by part rows unbounded preceding) - inside as before",
        f"sum(inside) over ({by}) as total",
    ), f"{name}-before")
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups]
    on = F.col("part") == F.shiftright("row", 33)
    for condition in same:
        on = on & condition
    return ranged.join(before, on).select(*df.columns, (F.col("before") + F.col("row") - F.col("first")).alias("position"), "total")


STEPS = "array<struct<sibling:string,left:boolean>>"


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
    value_cols: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    carry: Sequence[str] = (), height: int = HEIGHT,
) -> DataFrame:
    """Per row: id, group, position, leaf, steps, subroot, root, and the columns ``carry``.

    A leaf is the digest of the row's values (``digest``). Per group, leaves ascend by id (null first,
    equal ids by leaf, so repeated rows are leaves side by side), and every two consecutive nodes, or the
    last alone, become their digest until one remains, the group's subroot. Subroots in the order of the
    groups (null first, bytewise) become the root in the same way. ``steps`` leads from a leaf to the
    root: per level the sibling's digest, null if there is none, and whether it stands on the left.

    Trees are built in blocks of ``2 ** height`` leaves, each held in van Emde Boas order; the roots of
    the blocks are the leaves of the next round. Only digests, ids and ``carry`` cross the network, so
    long texts do not. Other columns are not looked at; a table without rows has no row here.
    """
    work = Work(docs.sparkSession)
    leaves = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("kind"), digest([F.col(c) for c in value_cols]).alias("node"),
        *[F.col(c).alias(f"carry{n}") for n, c in enumerate(carry)],
    )
    leaves = _placed(work, work.write(leaves, "leaves"), ["kind"], ["id", "node"], "ranged")
    kinds = leaves.where("position = 0").select("kind")
    kinds = _placed(work, kinds, [], ["kind"], "kinds").select(
        F.col("kind").alias("of_kind"), F.col("position").alias("tree"), F.col("total").alias("trees"),
    )
    kinds = work.write(kinds, "trees")
    leaves = leaves.join(kinds, F.col("kind").eqNullSafe(F.col("of_kind"))).drop("of_kind")
    paths = _paths(work, work.write(leaves, "nodes"), "blocks", height)
    subroots = paths.where("position = 0").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("position"), F.col("trees").alias("total"),
        F.col("root").alias("node"),
    )
    tops = _paths(work, work.write(subroots, "subroots"), "tops", height).select(
        F.col("position").alias("tree"), F.col("steps").alias("further"), F.col("root").alias("top"),
    )
    return paths.join(tops, "tree").select(
        F.col("id").alias(id_col), F.col("kind").alias(group_col), "position", F.col("node").alias("leaf"),
        F.concat("steps", "further").alias("steps"), F.col("root").alias("subroot"), F.col("top").alias("root"),
        *[F.col(f"carry{n}").alias(c) for n, c in enumerate(carry)],
    )


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps lead to."""

    def parent(node: Column, step: Column) -> Column:
        sibling = F.coalesce(step["sibling"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(sibling, node)).otherwise(F.concat(node, sibling)).cast("binary"), 256)

    return F.aggregate(steps, leaf, parent)
