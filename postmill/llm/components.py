"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`node` and `root` (its component's smallest node) for every node of the edges `a`, `b`.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014), which end after about log(n) rounds in stars whose centres
    are the roots. Each round is written to the checkpoint folder; no edges reach the driver.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours move to its smallest one, itself included.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node's smaller neighbours and itself move to the smallest of them.
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def named_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`fp` and `component_id`, the smallest `first` of what is linked, for each row of `nodes` (`fp`, `first`).

    `links` (`a`, `b`) are of `fp`. Nodes are compared by `first`, so a component's root carries its id and no
    component is grouped or joined by its root. A null `first` is never the smallest unless alone.
    """
    named = nodes.select("fp", "first", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("node"))
    ends = links.join(named.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    roots = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "of")
    return named.join(roots, F.col("node") == F.col("of"), "left").select("fp", F.coalesce("root.first", "first").alias("component_id"))
