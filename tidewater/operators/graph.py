"""Connected components of an edge table, for graphs that fit no single machine.

Alternating large-star and small-star passes (Kiveris et al., 2014): each pass is one aggregation and one join, the
number of passes grows with the logarithm of the longest path. Every pass is written to the checkpoint folder, so
lineage stays short and lost executors cost no more than one pass. A node with very many neighbours never meets them
in one task: passes only aggregate a minimum per node and join it back.

Defined results: self loops and repeated edges change nothing, null ends are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller-or-equal (small) neighbours to the smallest of them."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = near.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_passes: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that is reachable. Only nodes with an edge have rows."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    pairs = cut(pairs)
    state = None
    for _ in range(max_passes):
        pairs = cut(_star(_star(pairs, True), False))
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle within {max_passes} passes")
    # settled: every edge points at its component's smallest node
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
