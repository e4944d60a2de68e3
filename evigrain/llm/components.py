"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join that deals the links of a node with very many of them over parts;
a row never carries a group. Every step is written to the shared folder; a lost executor
costs the running step only. Links stay distributed; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.llm.shared import near_join, settled, written


def _pull(pairs: DataFrame) -> DataFrame:
    """Point each pair (u, v) of node and neighbour at the least of u and all its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near_join(pairs, written(least, "least"), ["u"])


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that links reach, for each node of links (a, b) between comparable ids."""
    spark = links.sparkSession
    edges = settled(spark, lambda: links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        after = settled(spark, lambda e=edges: _round(e), "links")
        if after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            root = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
        edges = after


def _round(edges: DataFrame) -> DataFrame:
    """A large-star step and a small-star step."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _pull(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    pulled = _pull(large)
    return pulled.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pulled.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
