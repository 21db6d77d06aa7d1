"""Sharding by a k-d tree over document metadata.

Every node is cut at the weighted median of its widest dimension, in proportion
to the leaves on either side, until the leaves have the target bytes. The medians
of a level are found together from bounded histograms that are refined where the
median lies, so the rows are only summed, never moved or sorted. Ties in a
dimension are cut by text and id, so any column may be constant.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import lookup_join, materialize, materialize_observed

# Buckets of a histogram, for each node of a level.
BUCKETS = 1 << 14
GRID, TIE = 28, 62

DIMENSIONS = {
    "lang": "crc32(coalesce(lang, ''))",
    "source": "crc32(coalesce(source, ''))",
    "size": "log2(size)",
}


@dataclass
class Node:
    leaves: int
    first: int
    weight: int = 0
    dim: str = ""
    cut: tuple[int, int] = (0, 0)
    kids: list[Node] = field(default_factory=list)

    def sql(self, leaf) -> str:
        """An expression of a row's leaf, or of its open node."""
        if not self.kids:
            return str(leaf(self))
        q, t = self.cut
        left, right = (k.sql(leaf) for k in self.kids)
        return f"case when {self.dim} < {q} or ({self.dim} = {q} and tie < {t}) then {left} else {right} end"


def _coordinates(documents: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Ids, sizes and coordinates, every dimension on a grid of its whole range."""
    rows = documents.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"size": F.octet_length("text").cast("bigint") + 16, "text_crc32": F.crc32(F.col("text").cast("binary"))})
    values = [f"cast({e} as double) as _{d}" for d, e in dimensions.items()]
    tie = f"text_crc32 * {1 << 30} + pmod(xxhash64(doc_id, monotonically_increasing_id()), {1 << 30}) as tie"
    rows = rows.selectExpr("bigint(doc_id) as doc_id", "size", "text_crc32", tie, *values)
    ends = [f(f"_{d}").alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]
    rows, seen = materialize_observed(rows, "metadata", *ends)
    for d in dimensions:
        lo, hi = seen[f"lo_{d}"], seen[f"hi_{d}"]
        scale = ((1 << GRID) - 1) / (hi - lo) if lo is not None and hi > lo else 0.0
        at = F.expr(f"bigint((_{d} - {lo!r}D) * {scale!r}D)") if scale else F.lit(0)
        rows = rows.withColumn(f"at_{d}", F.coalesce(at, F.lit(0)).cast("bigint"))
    return rows.drop(*[f"_{d}" for d in dimensions])


def _cuts(rows: DataFrame, root: Node, nodes: list[Node], slack: int) -> None:
    """Finds the cut of every node of a level, a histogram a round for all."""
    goal = {n.first: n.weight * (n.leaves // 2) // n.leaves for n in nodes}
    # Open range of every node: phase 0 along the dimension, 1 along the ties.
    state = {n.first: [0, 0, 1 << GRID, 0] for n in nodes}  # phase, lo, width, weight before
    open_nodes = list(nodes)
    while open_nodes:
        def part(n: Node) -> str:
            phase, lo, width, _ = state[n.first]
            step = -(-width // BUCKETS)
            column = "tie" if phase else n.dim
            inside = f"{column} >= {lo} and {column} < {lo + width}" + (f" and {n.dim} = {n.cut[0]}" if phase else "")
            return f"case when {inside} then {n.first * BUCKETS}L + ({column} - {lo}) div {step}L end"

        known = {n.first for n in open_nodes}
        cell = root.sql(lambda n: part(n) if n.first in known and n in open_nodes else "null")
        sums = rows.selectExpr("size", f"bigint({cell}) as cell").where("cell is not null").groupBy("cell").agg(F.sum("size").alias("w")).toArrow()
        cells, weights = sums["cell"].to_numpy(), sums["w"].to_numpy()
        order = np.argsort(cells)
        cells, weights = cells[order], weights[order]
        still = []
        for n in open_nodes:
            phase, lo, width, before = state[n.first]
            own = cells // BUCKETS == n.first
            bucket, total = cells[own] - n.first * BUCKETS, before + np.cumsum(weights[own])
            step = -(-width // BUCKETS)
            k = int(np.searchsorted(total, goal[n.first], "right"))
            if k >= len(bucket):
                n.cut = (n.cut[0], lo + width) if phase else (lo + width, 0)
                continue
            before = int(total[k - 1]) if k else before
            lo, weight = lo + int(bucket[k]) * step, int(total[k]) - before
            if weight <= slack or (phase and step == 1):
                # Of the two ends of the bucket the one nearer to the goal.
                at = lo + step if before + weight - goal[n.first] < goal[n.first] - before else lo
                n.cut = (n.cut[0], at) if phase else (at, 0)
            elif step == 1:
                n.cut, state[n.first] = (lo, 0), [1, 0, 1 << TIE, before]
                still.append(n)
            else:
                state[n.first] = [phase, lo, step, before]
                still.append(n)
        open_nodes = still


def kd_tree(rows: DataFrame, dimensions: list[str], leaves: int) -> Node:
    total = rows.agg(F.sum("size")).first()[0] or 0
    root = Node(leaves, 0, total)
    slack = max(1, total // leaves // 1000)
    while True:
        nodes = [n for n in _ends(root) if n.leaves > 1]
        if not nodes:
            return root
        stats = [F.sum("size").alias("w"), *[(f(d)).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]]
        own = rows.withColumn("node", F.expr(f"bigint({root.sql(lambda n: n.first)})")).groupBy("node").agg(*stats)
        found = {r["node"]: r for r in own.collect()}
        for n in nodes:
            r = found.get(n.first)
            n.weight = r["w"] if r else 0
            n.dim = max(dimensions, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"]) if r else dimensions[0]
        _cuts(rows, root, nodes, slack)
        for n in nodes:
            n.kids = [Node(n.leaves // 2, n.first), Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)]


def _ends(node: Node) -> list[Node]:
    return [x for k in node.kids for x in _ends(k)] if node.kids else [node]


def kd_shards(documents: DataFrame, shards: int | None = None, target_bytes: int = 1 << 30, dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``documents``.

    Sizes are UTF-8 bytes of the text (null: none) plus 16 and near equal over
    the shards; slots count from 0 without gaps in each. Without ``shards`` their
    number follows from ``target_bytes``. A cut leaves a row on the side that comes
    nearer to the goal. Equal texts may be parted; rows of equal text and id are told
    apart by their place in the input. Null metadata counts as empty, null ids
    and repeated rows are rows like any other, extra columns are not looked at.
    ``dimensions`` are SQL expressions over the columns and ``size``.
    """
    rows = _coordinates(documents, dimensions)
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    root = kd_tree(rows, [f"at_{d}" for d in dimensions], shards)
    rows = rows.select("doc_id", "size", "text_crc32", F.expr(f"int({root.sql(lambda n: n.first)})").alias("shard"))
    rows = rows.sortWithinPartitions("shard", "doc_id").withColumn("place", F.monotonically_increasing_id())
    rows = materialize(rows, "shards").withColumn("part", F.expr("place >> 33"))
    groups = rows.groupBy("shard", "part").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = lookup_join(rows, groups, ["shard", "part"])
    return rows.selectExpr("doc_id", "size", "text_crc32", "shard", "place - begin + before as slot")


def write_shards(documents: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes ``documents`` into a folder a shard; ids must be unique and not null."""
    placed = documents.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    placed.repartition("shard", F.expr("slot div 100000")).write.partitionBy("shard").parquet(path)
