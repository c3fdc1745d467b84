"""Merkle dataset manifest: a tree of SHA-256 midstates over all rows of a table.

Leaves stand in groups (a language), in order of their ids. In each group every eight
consecutive nodes, the last run fewer, become their parent's digest until one is left, the
group's subroot; subroots in order of group become the root in the same way. A parent keeps
a copy of its hash state before each child slot: folding a changed leaf resumes the state
before that slot with the replacement and the siblings on its right, level by level.

The order is found by range partitioning: rows are sorted once, and a row's place is its
number in its partition plus the counts of the partitions before it, of which there is one
row a partition and group. Blocks of 4,096 nodes (four levels) are the unit of all other
work, so a group that holds all rows is many tasks. Block roots are the nodes of the next
tier, one for 4,096, until a group has one block; then paths go down: each block
gets the siblings above it (a few KB), and opens its own four levels for its nodes. Lost
tasks are redone from written tables.

Results by case: a null group is one of its own, before all others; null ids come first in
their group; rows with equal ids stand in order of their leaves, repeated rows have a leaf
each; null values have a mark of their own, so they differ from empty ones; an empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.shared import materialize

#: Children of a node, levels of a block (so of 4,096 nodes), and characters of a digest.
FAN, LEVELS, HEX = 8, 4, 64
#: Rows of a batch that is given back: a proof or a path is a few KB.
SOME = 512
#: What stands above a block, and the columns of nodes' paths.
ABOVE = ("path", "subroot", "root")


def marked(value: Column) -> Column:
    """A value with its length in bytes, ``-`` for null, so that no two rows read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(marked, values)), 256)


def group_key(group: Column) -> Column:
    """A group as a string in the groups' order, null first."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their group by ``order``, and ``total``, its size."""
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    held = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("part", F.shiftright("at", 33))
    parts = held.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    return held.join(shifts, ["grp", "part"]).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def blocks(nodes: DataFrame, size: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Nodes in rows of ``size``: ``nodes`` (and each of ``carried``) hold their values in order."""
    values = ("node", *carried)
    row = F.sort_array(F.collect_list(F.struct("pos", *values)))
    gathered = nodes.groupBy("grp", F.expr(f"pos div {size}").alias("block")).agg(F.max("total").alias("total"), row.alias("rows"))
    listed = lambda c: F.transform("rows", lambda r: r[c])
    joined = [F.array_join(listed("node"), "").alias("nodes"), *((F.array_join(listed(c), "") if c == "claim" else listed(c)).alias(f"{c}s") for c in carried)]
    return materialize(gathered.select("grp", "block", "total", *joined), "merkle-blocks")


class Tree:
    """A block's nodes, level by level, with each node's siblings and the state before its slot."""

    def __init__(self, nodes: str, total: int, levels: int = LEVELS) -> None:
        cut = nodes.encode()
        level = [cut[k : k + HEX] for k in range(0, len(cut), HEX)]
        self.levels: list[list[tuple]] = []  # of (state before the slot, left siblings, right siblings)
        depth = levels if total > FAN**levels else None  # a group's only block ends with its subroot
        while (len(self.levels) < depth) if depth else (len(level) > 1):
            slots, above = [], []
            for at in range(0, len(level), FAN):
                run = level[at : at + FAN]
                state = hashlib.sha256()
                for k, child in enumerate(run):
                    slots.append((state.copy(), b"".join(run[:k]), b"".join(run[k + 1 :])))
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.levels.append(slots)
            level = above
        self.root = level[0]

    def climb(self, k: int) -> Iterator[tuple]:
        for slots in self.levels:
            yield slots[k]
            k //= FAN

    def path(self, k: int) -> bytes:
        """The siblings of node ``k`` on each level."""
        return b"".join(bytes((len(left) // HEX, len(right) // HEX)) + left + right for _, left, right in self.climb(k))


def opened(path: bytes) -> list[tuple]:
    """A path's levels, with the state before the slot on each."""
    at, out = 0, []
    while at < len(path):
        left, right = (path[at + k] * HEX for k in (0, 1))
        first, second = path[at + 2 : at + 2 + left], path[at + 2 + left : at + 2 + left + right]
        out.append((hashlib.sha256(first), first, second))
        at += 2 + left + right
    return out


def fold(node: bytes, slots: Iterator[tuple] | list[tuple]) -> bytes:
    """The digest at the top with ``node`` in the lowest slot."""
    for state, _, right in slots:
        resumed = state.copy()
        resumed.update(node)
        resumed.update(right)
        node = resumed.hexdigest().encode()
    return node


def roots_of(tier: DataFrame, levels: int) -> DataFrame:
    """``grp``, ``pos``, ``below`` (nodes of the group in this tier) and ``node`` of each block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, total = batch.column("nodes"), batch.column("total")
            roots = [Tree(nodes[k].as_py(), total[k].as_py(), levels).root.decode() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), total, pa.array(roots, pa.string())], names=["grp", "pos", "below", "node"])

    return tier.select("grp", "block", "total", "nodes").mapInArrow(run, "grp string, pos long, below long, node string")


def paths_of(tier: DataFrame, levels: int) -> DataFrame:
    """``grp``, ``pos`` and ABOVE of each node of a tier that has ABOVE for its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grp, block, total, nodes, above, *tops = (batch.column(c)[k].as_py() for c in ("grp", "block", "total", "nodes", *ABOVE))
                tree, n = Tree(nodes, total, levels), len(nodes) // HEX
                for at in range(0, n, SOME):
                    some = range(at, min(n, at + SOME))
                    first, *same = (pa.array([v] * len(some), pa.string()) for v in (grp, *tops))
                    places, paths = pa.array([block * FAN**levels + j for j in some]), pa.array([tree.path(j) + above for j in some], pa.binary())
                    yield pa.RecordBatch.from_arrays([first, places, paths, *same], names=["grp", "pos", *ABOVE])

    return tier.select("grp", "block", "total", "nodes", *ABOVE).mapInArrow(run, "grp string, pos long, path binary, subroot string, root string")


def forest(nodes: DataFrame, levels: int, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over ``nodes(grp, pos, total, node)``, lowest first, and ``grp, node`` of each group's subroot."""
    size = FAN**levels
    tiers, tops = [blocks(nodes, size, carried)], []
    most = tiers[0].select(F.max("total")).first()[0] or 0
    while True:
        roots = roots_of(tiers[-1], levels)
        tops.append(roots.where(F.col("below") <= size).select("grp", "node"))
        if most <= size:
            break
        most = -(-most // size)
        tiers.append(blocks(roots.where(F.col("below") > size).select("grp", "pos", F.ceil(F.col("below") / size).alias("total"), "node"), size))
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return tiers, materialize(found, "merkle-subroots")


def descend(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest tier with ABOVE for each block; ``tops(grp, path, subroot, root)`` is above each group.

    Only a group's one block of its highest tier meets the group's row; others meet the path
    of their own root.
    """
    found = None
    for tier in reversed(tiers):
        met = tier.where(F.col("total") <= FAN**levels).join(tops.select("grp", *ABOVE), "grp")
        if found is not None:
            paths = paths_of(found, levels)
            met = met.unionByName(tier.where(F.col("total") > FAN**levels).join(paths.withColumnRenamed("pos", "block"), ["grp", "block"]))
        found = met
    return found


def prove(rows: DataFrame, *, id_type: str = "bigint", levels: int = LEVELS) -> DataFrame:
    """Each leaf's place in the tree of ``rows(grp, doc_id, node, claim)``.

    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (its siblings' digests, level by
    level, left to right) and ``folded_root``, the root with ``claim`` in the leaf's place.
    """
    tiers, subroots = forest(placed(rows, ["doc_id", "node", "claim"]), levels, ("doc_id", "claim"))
    named = placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
    named = materialize(named, "merkle-groups")
    top_tiers, top = forest(named.select("grp", "pos", "total", "node"), levels)
    highest = descend(top_tiers, top.select("grp", F.lit(b"").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root")), levels)
    paths = paths_of(highest, levels).select("pos", "path", "root")
    tops = materialize(named.join(paths, "pos").select(F.col("name").alias("grp"), "path", F.col("node").alias("subroot"), "root"), "merkle-tops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                total, nodes, claims, path, subroot, root = (batch.column(c)[k].as_py() for c in ("total", "nodes", "claims", "path", "subroot", "root"))
                ids, tree, above = batch.column("doc_ids").slice(k, 1).flatten(), Tree(nodes, total, levels), opened(path)
                outer = b"".join(left + right for _, left, right in above)
                for at in range(0, len(ids), SOME):
                    some = range(at, min(len(ids), at + SOME))
                    proofs = [(b"".join(left + right for _, left, right in tree.climb(j)) + outer).decode() for j in some]
                    folded = [fold(fold(claims[j * HEX : (j + 1) * HEX].encode(), tree.climb(j)), above).decode() for j in some]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(some)), pa.array([nodes[j * HEX : (j + 1) * HEX] for j in some]), pa.array([subroot] * len(some)), pa.array([root] * len(some)), pa.array(proofs), pa.array(folded)],
                        names=["doc_id", "leaf", "subroot", "root", "proof", "folded_root"],
                    )

    found = descend(tiers, tops, levels).select("total", "nodes", "claims", "doc_ids", "path", "subroot", "root")
    return found.mapInArrow(run, f"doc_id {id_type}, leaf string, subroot string, root string, proof string, folded_root string")
