"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, label) for every node of `links` (a, b): the label is the smallest node of its component.

    Alternating large-star and small-star steps: the links of each node are turned to its smallest neighbour until
    nothing changes, in a number of rounds that grows with the logarithm of the graph. Each round is written to `folder`.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen, turn = written(edges, f"{folder}/edges0"), None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, turn = state, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), f"{folder}/edges{turn}")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(roots)
