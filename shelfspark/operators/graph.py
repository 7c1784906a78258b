"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import dropped, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (``node``), ``edges`` (``a``, ``b``) to ``node``, ``root``, the
    smallest node that it is linked to.

    Every round links each node's larger neighbours to its least neighbour, then
    the smaller ones; this ends in stars around the roots after few rounds, and
    goes on until a round changes nothing."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).withColumn("m", F.least("c", "m"))
        up = both.where("v > u").join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = up.join(least(up), F.col("u") == F.col("c"))
        pairs = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        old, now = now, written(pairs.distinct())
        new = state(now)
        dropped(old)
        if new == was:
            break
        was = new
    roots = now.select(F.col("u").alias("_u"), F.col("v").alias("_r"))
    return nodes.select("node").distinct().join(roots, F.col("node") == F.col("_u"), "left").select("node", F.coalesce("_r", "node").alias("root"))
