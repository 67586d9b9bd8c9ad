"""Connected components by alternating stars, with every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashgrove.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours and itself."""
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "components")
    least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "components")
    return both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. ``a`` < ``b`` in every edge."""
    least = materialize(edges.groupBy("b").agg(F.min("a").alias("least")), "components")
    moved = edges.join(least, "b").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), "b")).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``links``; the component is its smallest node.

    Self-links and null ends are ignored; repeated links count once; without links the result is empty. Each round is
    written to the shared folder, so no lineage grows; hubs meet in joins of two written tables, which adaptive execution splits.
    Rounds grow with the logarithm of the longest chain; ``max_rounds`` raises rather than return something unfinished.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(ends.where("a < b").distinct(), "components")
    summary = ["count(*) n", "coalesce(sum(cast(xxhash64(a, b) as decimal(38))), 0) total"]
    state = edges.selectExpr(*summary).first()
    for _ in range(max_rounds):
        if state["n"] == 0:
            break
        edges = materialize(_small_star(materialize(_large_star(edges), "components")), "components")
        now = edges.selectExpr(*summary).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: not finished after {max_rounds} rounds")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
