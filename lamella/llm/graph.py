"""Connected components by joins: contraction with min-hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, scope, stored


def _jump(parents: DataFrame, label: str) -> DataFrame:
    """Each node's root in a forest of (node, root), whose roots point at themselves.

    Every round halves the depth, so rounds grow with its logarithm.
    """
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = stored(parents.select("node", "root").join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), label)
        free(parents)
        if not after.where("moved").limit(1).count():
            return after.select("node", "root")
        parents = after


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for each node that has a link, with the least node of its component; ``edges`` holds longs a, b.

    Each round, every node hooks onto its least neighbour if that is less than itself, the trees contract to their
    roots, and links within a tree go. Nothing is gathered by node beyond a minimum, so a hub costs no more than its
    links; the rounds end when no link is left. Self-links and repeated links are harmless; no links give no rows.
    """
    with scope() as keep:
        left = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
        whole = None
        while left.limit(1).count():
            both = left.union(left.select("b", "a"))
            parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), label)
            trees = _jump(parents, label)
            to = lambda c: trees.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
            after = stored(
                left.join(to("a"), "a").join(to("b"), "b").where("a_root != b_root")
                .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(),
                label,
            )
            free(left)
            left = after
            if whole is None:
                whole = trees
            else:
                up = trees.select(F.col("node").alias("root"), F.col("root").alias("above"))
                whole = whole.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        return keep(stored(whole if whole is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root")), label))
