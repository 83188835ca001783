"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, materialize, release_since


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    """For each a, the least of itself and its neighbours. Written out, so that the join which
    follows reads two plain shuffles and Spark can split a vertex with very many links."""
    return materialize(arcs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        arcs.join(_least_neighbour(arcs), "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least_neighbour(edges)
    to_least = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of `links`; component is the smallest node reachable.

    Links are undirected; loops, repeats and rows with a null end are ignored, and a node that has
    only such rows does not appear. Each round is joins and partial aggregations; only a count
    and a checksum reach the driver.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    start = marked()
    edges = materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if not now[0] or now == mark:
            break
        # Stars already: each node points once, and to a node that points nowhere.
        if now[0] == now[2] and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            break
        mark = now
        edges = materialize(_small_star(materialize(_large_star(edges))))
        release_since(start)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
