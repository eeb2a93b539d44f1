"""Connected components of a distributed edge table by alternating star contraction.

Every round maps edges to edges (no adjacency list is ever gathered): the large-star step points
the larger neighbours of each node to its least neighbour, the small-star step does so for the
smaller ones. Minima are aggregated before the shuffle; the join that brings them back may be split
by adaptive execution when one node has very many edges. Rounds grow with the logarithm of the
longest chain. Each round is written to the shared folder, so a lost executor repeats one round.
A round deals its edges anew four times, whatever their number: many tasks of few rows cost the
driver memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(both: DataFrame) -> DataFrame:
    """both: (u, v) in both directions. With m(u) the least of u and its v: edges (v, m(u)) for v > u, so an edge gives
    one row; repeats are left to the end of the round."""
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: (u, v), u > v. With m(u) the least v of u: edges (v, m(u)) for the other v, and (u, m(u)) in that one's place."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: columns a, b (long); self loops, repeats and nulls are allowed and say nothing.

    Returns (node, root) for each node that has an edge to another one; root is the least node of
    its component. Nodes without edges are not listed.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = materialise(_small_star(_large_star(both)).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
