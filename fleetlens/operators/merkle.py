"""Merkle trees over segments of any size: roots and inclusion proofs.

Leaves are numbered in blocks, so no segment's leaves are sorted in one task. A round groups the nodes of a segment by
position into subtrees of 2^HEIGHT and hashes each up to one node; the parity rule (an odd last node is paired with itself)
depends on a level's length only, which follows from the number of leaves. A tree of n leaves takes log(n) / HEIGHT rounds, each
a shuffle of 1 / 2^HEIGHT of the one before. A leaf's proof is its siblings within its subtree, then those of the subtree's
node in the next round, which a subtree fetches once for all of its leaves: proofs are spelt out last and never shuffled.

Defined cases: a segment of one leaf has the leaf as its root and an empty proof; null leaves are hashed as the empty text
where hashed here; segments don't depend on each other; no rows give no roots (EMPTY is what stands for a tree without leaves).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.places import ROWS_A_BLOCK, places

HEIGHT = 8


def pair_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat_ws(":", left, right), 256)


def paired(level: str):
    """The hash above a place's two neighbours; an odd last one is paired with itself."""
    return lambda j: pair_hash(F.get(level, j * 2), F.coalesce(F.get(level, j * 2 + 1), F.get(level, j * 2)))


def numbered(rows: DataFrame, segment: Column, order: str, leaf: Column, rows_a_block: int) -> DataFrame:
    """segment, i, n and h: a segment's leaves by position, and how many these are."""
    nodes = rows.select(segment.alias("segment"), F.col(order).alias("o"), leaf.alias("h"))
    return places(nodes, ["segment"], ["o"], rows_a_block, "i", "n").select("segment", "i", "n", "h")


def grouped(nodes: DataFrame) -> DataFrame:
    """Subtrees of nodes (segment, i, n, h): segment, n, g (the subtree's position) and h0, its nodes' hashes in order."""
    out = nodes.groupBy("segment", "n", F.shiftright("i", HEIGHT).alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
    return out.select("segment", "n", "g", F.transform("x", lambda x: x["h"]).alias("h0"))


def climb(subtrees: DataFrame) -> DataFrame:
    """subtrees with the arrays h1 to h{HEIGHT} of their further levels."""
    out = subtrees
    for k in range(HEIGHT):
        below, halves = f"h{k}", F.sequence(F.lit(0), F.expr(f"(size(h{k}) + 1) div 2 - 1").cast("int"))
        above = F.transform(halves, paired(below))
        out = out.withColumn(f"h{k + 1}", F.when(length_at(k) > 1, above).otherwise(F.col(below)))
    return out


def length_at(level: int) -> Column:
    """How many nodes the whole level has."""
    return F.shiftright(F.col("n") + ((1 << level) - 1), level)


def tops(subtrees: DataFrame) -> DataFrame:
    """The nodes of the next round."""
    return subtrees.select("segment", F.col("g").alias("i"), length_at(HEIGHT).alias("n"), F.get(f"h{HEIGHT}", F.lit(0)).alias("h"))


def rounds(rows: DataFrame, segment: Column) -> int:
    most = rows.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(0, -(-(max(most, 1) - 1).bit_length() // HEIGHT))


def roots(rows: DataFrame, segment: Column, order: str, leaf: Column, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """segment, leaves and root; leaf: the leaves' hashes, which `order` (a whole number) tells apart."""
    nodes = numbered(rows, segment, order, leaf, rows_a_block)
    counts = nodes.groupBy("segment").agg(F.count(F.lit(1)).alias("leaves"))
    for _ in range(rounds(rows, segment)):
        nodes = tops(climb(grouped(nodes)))
    out = nodes.select(F.col("segment").alias("own"), "h")
    return counts.join(out, F.col("segment").eqNullSafe(F.col("own"))).select("segment", "leaves", F.col("h").alias("root"))


def inclusion_proofs(rows: DataFrame, segment: Column, order: str, leaf: Column, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """A row for each leaf: segment, leaf_index, leaf, siblings (hash, left) from the bottom up, and the segment's root."""
    proofs = node_proofs(numbered(rows, segment, order, leaf, rows_a_block), rounds(rows, segment))
    return proofs.select("segment", F.col("i").alias("leaf_index"), F.col("h").alias("leaf"), "siblings", "root")


def node_proofs(nodes: DataFrame, left: int) -> DataFrame:
    """segment, i, h, siblings and root of each of nodes (segment, i, n, h), which `left` rounds bring to the top."""
    if not left:
        return nodes.select("segment", "i", "h", no_siblings().alias("siblings"), F.col("h").alias("root"))
    subtrees = grouped(nodes)
    if left == 1:
        subtrees = climb(subtrees).withColumns({"more": no_siblings(), "root": F.get(f"h{HEIGHT}", F.lit(0))})
    else:
        above = node_proofs(tops(climb(subtrees)), left - 1).select(F.col("segment").alias("own"), F.col("i").alias("at"), F.col("siblings").alias("more"), "root")
        # Levels are hashed again after the join, which so takes a subtree's leaves along and nothing else.
        subtrees = climb(subtrees.join(above, F.col("segment").eqNullSafe(F.col("own")) & (F.col("g") == F.col("at"))).select("segment", "n", "g", "h0", "more", "root"))
    each = F.transform("h0", lambda h, j: F.struct((F.shiftleft("g", HEIGHT) + j).alias("i"), h.alias("h"), F.concat(own_siblings(j), "more").alias("siblings")))
    return subtrees.select("segment", "root", F.inline(each)).select("segment", "i", "h", "siblings", "root")


def no_siblings() -> Column:
    return F.array().cast("array<struct<hash:string,left:boolean>>")


def own_siblings(j: Column) -> Column:
    """The siblings of a subtree's j-th node up to the subtree's top."""
    found = []
    for k in range(HEIGHT):
        at = F.shiftright(j, k)
        other = F.when(at % 2 == 0, F.least(at + 1, F.size(f"h{k}") - 1)).otherwise(at - 1)
        found.append(F.when(length_at(k) > 1, F.struct(F.get(f"h{k}", other).alias("hash"), (other < at).alias("left"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def proves(leaf: Column, siblings: Column, root: Column) -> Column:
    """Whether the siblings lead from the leaf to the root."""
    return F.aggregate(siblings, leaf, lambda h, s: F.when(s["left"], pair_hash(s["hash"], h)).otherwise(pair_hash(h, s["hash"]))) == root
