"""Connected components by alternating large and small stars.

All of it is joins and aggregations over the edge table, which is written after
each round; nothing is collected but a count and a checksum. A hub with very
many neighbours is one key of a minimum, which combines before the shuffle, and
of a join that adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revsift.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; a component is named by its smallest node.

    Null ends and loops are ignored; no edges give an empty table."""
    # every aggregate is written before it is joined back, so that the join deals both sides anew and can split a hub
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), name)
    before = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        before = tuple(sums)
        around = _both_ways(edges)
        least = written(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = (large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, name)
