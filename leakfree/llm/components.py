"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(sym: DataFrame, small: bool) -> DataFrame:
    """Every node's neighbours are joined to the smallest of the node and its neighbours.

    Only minima are gathered per node, never its neighbours, so a node with many edges costs one
    row per map task in the aggregation; the join on it may be split by the planner.
    """
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sym.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v: long); component is the smallest node.

    Null ends and self-loops are ignored; repeated edges count once; no edges give no rows. The number
    of rounds grows with the logarithm of the number of nodes; each ends in a written table, so
    that a lost executor costs at most one round. More than ``max_rounds`` rounds raise an error.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
    edges = edges.where(F.col("u") != F.col("v"))
    current = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = _summary(current)
    for _ in range(max_rounds):
        sym = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(sym, small=False), "components")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        current = stored(_star(down, small=True), "components")
        after = _summary(current)
        if after == before:
            roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError("connected components did not settle")
