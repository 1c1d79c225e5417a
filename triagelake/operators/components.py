"""Connected components by alternating large-star and small-star rounds.

Each round is two joins on the edges; edges are written to the shared folder
between rounds, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import drop, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller and itself) to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a <> b")
    return out.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its least node.

    Nodes are bigint.  Self-loops make their node known; null ends are ignored.
    """
    pairs = edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b")).where("a is not null and b is not null")
    pairs = keep(pairs.distinct(), "cc-input")
    now = keep(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        after = keep(_star(_star(now, True), False), "cc")
        drop(now)
        now, was = after, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    # Every node but the least of a component now has one edge, to the least.
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return nodes.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
