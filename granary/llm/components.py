"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.skew import salted_join
from granary.scratch import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.min("v").alias("m"))
    larger = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    joined = salted_join(larger, least, "u", "v", total=total)
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = salted_join(down, least, "u", "v", total=total).filter(F.col("v") != F.col("m"))
    linked = others.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """A digest that changes whenever the set of edges does."""
    h = F.xxhash64("u", "v")
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.bit_xor(h),
            F.sum(F.pmod(h, F.lit(1 << 30))),
        ).first()
    )


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is its smallest node.

    Self-loops and repeated edges do no harm. No neighbourhood is gathered in
    one task: each star is a grouped minimum joined back to the edges. Each
    round is written to the shared scratch folder.
    """
    edges = materialize(edges.select("u", "v").filter("u != v").distinct(), "components")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        large = materialize(_large_star(edges, state[0]), "components")
        small = materialize(_small_star(large, state[0]), "components")
        discard(edges, large)
        edges, last = small, state
        state = _state(edges)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
