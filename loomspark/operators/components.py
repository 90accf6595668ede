"""Connected components of an edge list, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id that the node is linked with over any number of edges.

    Alternates large-star and small-star rounds, which end in O(log n) rounds also for long chains. Both steps only
    group by node with a min, so a hub with many neighbours is pre-aggregated; every round is cut by a checkpoint in the shared folder.
    Null ends and self-loops link nothing and are left out; repeated and reversed edges count once; without edges the result is empty.
    """
    both = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    links = both.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut(links)
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node points to the node's smallest neighbour (itself included).
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = cut(small)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
