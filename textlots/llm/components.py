"""Connected components of a large graph, by joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlots.llm.common import settled

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst); root is the smallest reachable node.

    Each round links all larger neighbours of a node to its smallest neighbour, then all
    smaller ones, until every node hangs on its root directly. The number of rounds grows
    with the logarithm of the longest chain; the edges never outgrow the input.
    """
    edges = settled(_directed(edges))
    for _ in range(MAX_ROUNDS):
        large = _linked(edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), larger=True)
        edges = settled(_linked(large, larger=False))
        if _all_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionAll(
        edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another node."""
    sides = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select("dst", F.lit(0), F.lit(1))
    )
    nodes = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).distinct()


def _linked(edges: DataFrame, larger: bool) -> DataFrame:
    """Neighbours of every src, on the larger or the smaller side, tied to its smallest one."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    least = least.withColumn("least", F.least("src", "least"))
    tied = edges.join(least, "src")
    if larger:
        ties = tied.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        ties = tied.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionAll(
            least.select("src", F.col("least").alias("dst"))
        )
    return _directed(ties)
