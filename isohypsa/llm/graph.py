"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohypsa.staging import stage


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b: long).

    Nodes point to the smallest neighbour known; each round joins larger neighbours to the smallest one and then
    smaller ones too, until every node points straight at its smallest. A star of any size is summed before it moves; rounds grow with the
    logarithm of the longest path, and each is cut by a written table."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stage(large.filter("a != b").distinct(), "large-star")
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(low, "a").select("b", "a", "m")
        edges = stage(small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
