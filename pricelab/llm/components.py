"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial-aggregated minimum and a join on the node, so a hub with very many neighbours is
never gathered: its minimum is combined map-side and its rows of the join can be split.  Every round is
written to the shared scratch folder; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    scratch = Scratch(edges.sparkSession)
    e, last = scratch.stored(e, "edges"), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("s")).first()
        if state == last or not state["n"]:
            break
        last = state
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.stored(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = scratch.stored(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        scratch.drop(keep_last=1)
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
