"""Connected components of a graph of 64-bit nodes, by alternating large and small stars.

No task gathers a node's neighbours: every step is a minimum by key, which combines before
the shuffle, and an equi-join. Each round ends in a shared table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_rows, spill


class Union:
    """Union-find over any hashable items; the least item of a set is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up[x]
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True


def _combine(edges: DataFrame) -> DataFrame:
    """Within each task, replace the edges by stars of their components there."""

    def run(batches):
        for b in batches:
            u = Union()
            for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
                u.join(x, y)
            nodes = list(u.up)
            roots = [u.find(x) for x in nodes]
            keep = [i for i, (x, r) in enumerate(zip(nodes, roots, strict=True)) if x != r]
            yield {"u": pa.array([nodes[i] for i in keep], pa.int64()), "v": pa.array([roots[i] for i in keep], pa.int64())}

    return map_rows(edges, "u bigint, v bigint", run)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component."""
    now = spill(_combine(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = spill(small, "cc")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if mark == seen or mark[0] == mark[2] and _flat(now):
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _flat(stars: DataFrame) -> bool:
    """Whether no centre of a star hangs on another star."""
    return stars.select("v").join(stars.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
