"""Connected components of a graph given as a table of links, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for each node of a link: component is the smallest node that it reaches.

    Links to itself or to null, repeated links and both directions are allowed. Alternates large-star and small-star
    steps until a step changes nothing; each step groups by node with partial minima, and its result is a table in
    the shared folder. A node of a very high degree is never gathered: its minimum is aggregated and joined back.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.where("u != v").distinct())
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
