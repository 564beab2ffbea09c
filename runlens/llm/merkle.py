"""Merkle dataset manifest whose trees are stored in van Emde Boas layout.

Every row is a leaf, every group of rows (a source) a tree of fanout 16, and the roots of the trees are the leaves of one
tree above them. A tree is cut into aligned blocks of HEIGHT levels. A block is one row: its nodes lie in van Emde Boas
order (the upper half of the levels first, then each subtree below, both laid out the same way), so a node's address is
arithmetic on its depth and number, for building as for looking up siblings. Roots of blocks are the leaves of the blocks
of the next stage, until a tree has one block left; proofs come down the same stages, each block adding its siblings to
what lies above its root.

Positions of leaves come from a range sort and prefix sums over its parts, so the largest group is as spread as any.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import common

BITS, HEIGHT = 4, 2  # 2^BITS children of a node; levels that a block adds above its leaves
BLOCK_LEAVES = 1 << BITS * HEIGHT
_PROOF = "array<struct<place: int, siblings: binary>>"


def size(levels: int) -> int:
    """Nodes of a complete tree."""
    return ((1 << BITS * levels) - 1) // ((1 << BITS) - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Where the nodes of a depth (root: 0) stand in the layout of a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(number)
    top = levels // 2
    if depth < top:
        return address(top, depth, number)
    below = depth - top
    subtree, inner = number >> BITS * below, number & ((1 << BITS * below) - 1)
    return size(top) + subtree * size(levels - top) + address(levels - top, below, inner)


def height(total: int) -> int:
    """Levels above the leaves of a block in a tree that has `total` nodes at the block's lowest level."""
    h = 0
    while h < HEIGHT and (1 << BITS * h) < total:
        h += 1
    return h


def _arrow_proof() -> pa.DataType:
    return pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.binary())]))


class Block:
    """The nodes of one aligned subtree. Digests are raw; hashes are taken over their hexadecimal text."""

    def __init__(self, leaves: int, h: int, nodes: bytes | None = None):
        self.leaves, self.h = leaves, h
        self.count = [-(-leaves // (1 << BITS * (h - depth))) for depth in range(h + 1)]
        used = 1 + max(int(address(h + 1, depth, np.arange(n)).max()) for depth, n in enumerate(self.count))
        self.nodes = np.zeros((used, 32), np.uint8) if nodes is None else np.frombuffer(nodes, np.uint8).reshape(-1, 32)

    @staticmethod
    def built(digests: list[bytes], h: int) -> Block:
        block = Block(len(digests), h)
        block.nodes[address(h + 1, h, np.arange(len(digests)))] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        for depth in range(h - 1, -1, -1):
            parents = b"".join(sha256(block.family(depth + 1, x).hex().encode()).digest() for x in range(block.count[depth]))
            block.nodes[address(h + 1, depth, np.arange(block.count[depth]))] = np.frombuffer(parents, np.uint8).reshape(-1, 32)
        return block

    def family(self, depth: int, parent: int) -> bytes:
        """The children of a node, in order."""
        first = parent << BITS
        return self.nodes[address(self.h + 1, depth, np.arange(first, min(first + (1 << BITS), self.count[depth])))].tobytes()

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def proofs(self):
        """For each leaf its steps inside the block: place among the children, and the others."""
        known: dict[tuple[int, int], bytes] = {}
        for leaf in range(self.leaves):
            steps, at = [], leaf
            for depth in range(self.h, 0, -1):
                place, parent = at & ((1 << BITS) - 1), at >> BITS
                if (depth, parent) not in known:
                    known[depth, parent] = self.family(depth, parent)
                own = known[depth, parent]
                steps.append({"place": place, "siblings": own[: 32 * place] + own[32 * (place + 1) :]})
                at = parent
            yield steps


def folded(digest: bytes, proof: list[dict]) -> bytes:
    """The root that a leaf and its proof lead to."""
    for step in proof:
        cut = 32 * step["place"]
        digest = sha256((step["siblings"][:cut] + digest + step["siblings"][cut:]).hex().encode()).digest()
    return digest


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: of each value in order `-` if null, else its length in bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with _part, and spans (group, _part, _first, _ahead, _total): a row's position in its group is
    _row - _first + _ahead. The sorted rows are written, so their order stands; nulls come first."""
    rows = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(group, *order)
    rows = common.saved(rows.withColumn("_row", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_row", 33))
    spans = rows.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)  # a group has a row for each part of the sort
    ahead = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, spans.withColumns({"_ahead": ahead, "_total": F.sum("_n").over(whole)}).drop("_n")


def stages(items: DataFrame) -> list[DataFrame]:
    """Blocks of every stage, each written: tree, total, block, leaves, nodes, root. `items` has tree, position, total (of the
    tree) and digest; a tree's top block is the one with total of at most BLOCK_LEAVES."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        block = Block.built(table.column("digest").to_pylist(), height(table.column("total")[0].as_py()))
        return pa.table({"tree": table.column("tree")[:1], "total": table.column("total")[:1], "block": table.column("block")[:1],
                         "leaves": pa.array([block.leaves], pa.int32()), "nodes": pa.array([block.nodes.tobytes()], pa.binary()), "root": pa.array([block.root()], pa.binary())})

    out = []
    while True:
        cut = items.select("tree", "total", "digest", "position", F.expr(f"position div {BLOCK_LEAVES}").alias("block"))
        blocks = cut.groupBy("tree", "block").applyInArrow(build, "tree long, total long, block long, leaves int, nodes binary, root binary")
        out.append(common.saved(blocks, f"stage{len(out)}"))
        open_ = out[-1].where(F.col("total") > BLOCK_LEAVES)
        if open_.isEmpty():
            return out
        items = open_.select("tree", F.col("block").alias("position"), F.ceil(F.col("total") / BLOCK_LEAVES).alias("total"), F.col("root").alias("digest"))


def tops(blocks: list[DataFrame]) -> DataFrame:
    """tree, root of every tree."""
    found = [b.where(F.col("total") <= BLOCK_LEAVES).select("tree", "root") for b in blocks]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def opened(known: DataFrame) -> DataFrame:
    """tree, position, leaf, subroot, proof of every leaf of blocks that have the subroot and the proof of their root."""
    def down(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["leaves"], height(row["total"]), row["nodes"])
                n, first = block.leaves, row["block"] * BLOCK_LEAVES
                lowest = block.nodes[address(block.h + 1, block.h, np.arange(n))]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([row["tree"]] * n, pa.int64()), "position": pa.array(range(first, first + n), pa.int64()),
                    "leaf": pa.array([x.tobytes() for x in lowest], pa.binary()), "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                    "proof": pa.array([x + row["proof"] for x in block.proofs()], _arrow_proof())})

    rows = known.select("tree", "total", "block", "leaves", "nodes", "subroot", "proof")
    return rows.mapInArrow(down, f"tree long, position long, leaf binary, subroot binary, proof {_PROOF}")


def descended(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with subroot and proof (from the block's root to the top). `above` has tree, subroot and proof of
    every tree's root."""
    known = None
    for b in reversed(blocks):
        below = None if known is None else common.saved(opened(known), "proofs").select("tree", F.col("position").alias("block"), "subroot", "proof")
        known = b.where(F.col("total") <= BLOCK_LEAVES).join(above, "tree")
        if below is not None:
            known = known.unionByName(b.where(F.col("total") > BLOCK_LEAVES).join(below, ["tree", "block"]))
    return known


@dataclass
class Manifest:
    """leaves: key, group, digest, shown, tree, position, total; trees: tree, group, total; blocks and upper: the written stages
    of the trees and of the tree over them; root: the digest over all, None for an empty table."""

    leaves: DataFrame
    trees: DataFrame
    blocks: list[DataFrame]
    upper: list[DataFrame]
    root: bytes | None


def manifest(rows: DataFrame, key: str, group: str, digest: str = "leaf", presented: str | None = None) -> Manifest:
    """The manifest of rows that have a key, a group and a raw digest; `presented` is a digest that `audited` checks instead.

    Leaves ascend by key in their group, null first; rows of one key by digest; repeated rows are leaves of their own. Groups
    ascend by their bytes, null first. An empty table has no tree and no root. Other columns are not read, whatever their names.
    """
    shown = F.col(presented or digest).alias("shown")
    rows = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(digest).alias("digest"), shown)
    rows, spans = placed(rows, "group", ["key", "digest"])
    sizes = spans.groupBy("group").agg(F.max("_total").alias("total")).withColumn("_all", F.lit(0))
    sizes, order = placed(sizes, "_all", ["group"])
    position = (F.col("_row") - F.col("_first") + F.col("_ahead")).alias("position")
    trees = common.saved(sizes.join(order.drop("_all"), "_part").select("group", "total", position.alias("tree")), "trees")
    numbers = trees.select(F.col("group").alias("_of"), "tree")
    spans = spans.join(numbers, F.col("group").eqNullSafe(F.col("_of"))).select("_of", F.col("_part").alias("_at"), "_first", "_ahead", F.col("_total").alias("total"), "tree")
    same = (F.col("_part") == F.col("_at")) & F.col("group").eqNullSafe(F.col("_of"))
    leaves = common.saved(rows.join(spans, same).select("key", "group", "digest", "shown", "tree", "total", position), "leaves")
    blocks = stages(leaves)
    roots = tops(blocks).withColumnRenamed("root", "digest")
    count = F.lit(roots.count()).cast("long").alias("total")
    upper = stages(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), count, "digest"))
    top = tops(upper).first()
    return Manifest(leaves, trees, blocks, upper, bytes(top["root"]) if top else None)


def audited(found: Manifest) -> DataFrame:
    """One row per leaf: key, leaf, subroot, proof (siblings from the leaf to the root, with the leaf's place among them) and
    folded_root, to which the presented digest leads with that proof."""
    kind = found.leaves.schema["key"].dataType.simpleString()
    leaves = found.leaves.select("tree", F.expr(f"position div {BLOCK_LEAVES}").alias("block"), "position", "key", "digest", "shown")
    top = descended(found.upper, tops(found.upper).select("tree", F.col("root").alias("subroot"), F.array().cast(_PROOF).alias("proof")))
    above = common.saved(opened(top).select(F.col("position").alias("tree"), F.col("leaf").alias("subroot"), "proof"), "above")

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("position")
        row = right.to_pylist()[0]
        proofs = [x + row["proof"] for x in Block(row["leaves"], height(row["total"]), row["nodes"]).proofs()]
        ends = [folded(d, p) for d, p in zip(left.column("shown").to_pylist(), proofs)]
        return pa.table({"key": left.column("key"), "leaf": left.column("digest"), "subroot": pa.array([row["subroot"]] * len(ends), pa.binary()),
                         "proof": pa.array(proofs, _arrow_proof()), "folded_root": pa.array(ends, pa.binary())})

    pairs = leaves.groupBy("tree", "block").cogroup(descended(found.blocks, above).groupBy("tree", "block"))
    return pairs.applyInArrow(prove, f"key {kind}, leaf binary, subroot binary, proof {_PROOF}, folded_root binary")
