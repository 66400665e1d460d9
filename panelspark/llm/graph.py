"""Connected components by distributed union-find: star contraction of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written


def _hook(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    lowest = written(lowest, "lowest-neighbours")
    return (
        edges.join(lowest, edges.b == lowest.node)  # the larger end follows the smaller end's lowest
        .select("a", F.col("low").alias("b"))
        .unionByName(lowest.select(F.col("node").alias("a"), F.col("low").alias("b")).where("a > b"))
        .where("a > b")
        .distinct()
    )


def _compress(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    lowest = written(edges.groupBy("a").agg(F.min("b").alias("low")), "lowest-parents")
    return (
        edges.join(lowest, "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a > b")
        .unionByName(lowest.select("a", F.col("low").alias("b")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) for every end of a link; component is the smallest id reachable.

    The links (a, b) stay a distributed table; each round replaces every link by
    one to a smaller id and keeps the connections. Rounds grow with the
    logarithm of the longest chain. Only a row count and a checksum of the links
    reach the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = written(edges.distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = written(_compress(written(_hook(edges), "hooked")), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).unionByName(roots)
