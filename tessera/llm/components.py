"""Connected components of a distributed edge table by alternating star contraction: each
round links every node's larger neighbours to its smallest one, then its smaller neighbours
and itself to the smallest. Hubs are split: the smallest neighbour is a partial aggregation
and goes back to the edges by a join that AQE may split. Each round's edges are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (a, b), a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (smallest node reachable) of every node that has a link; ``links`` has
    the columns a and b in any order. Self-links and repeated links do no harm; no links give an
    empty table."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter(F.col("a") > F.col("b")).distinct(), name)
    state = None
    while True:
        edges = written(star(star(edges, large=True), large=False), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.unionByName(roots)
