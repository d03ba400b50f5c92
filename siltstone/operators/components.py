"""Connected components of links that a shuffle can hold, however large a component is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import kept


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b) with a link; root is the component's least node.

    Alternating large-star and small-star rounds: in each, a node's larger (then smaller) neighbours
    are linked to its least neighbour, until no link changes. The rounds grow with the logarithm of
    the longest chain. A node with a large share of all links, as the root of a large component has, is
    left to adaptive execution, which splits its partition of the join.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = e.unionByName(back) if large else back
        # Written, so that the join shuffles both sides by need and Spark splits a hot node's links.
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        met = both.join(least, "a")
        pairs = met.filter("b > a").select("m", F.col("b").alias("x")) if large else met.select("m", F.col("b").alias("x")).unionByName(least.select("m", F.col("a").alias("x")))
        return pairs.filter("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = kept(edges.select("a", "b"), "links")
    state = mark(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = kept(star(kept(star(now, True), "stars"), False), "stars")
        then, state = state, mark(now)
        if then == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
