"""Connected components of an edge table by alternating large and small stars.

Each round is two joins and two partly aggregated minima; the edges are written
to the shared folder after it, so lineage stays short and a hub's edges are
never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _minima(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (``u``, ``v``), in any direction, to ``node``, ``root``: the
    smallest node of its component, for every node but the roots.  Rounds go on
    until one changes nothing."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join reads two plain shuffles and a hub's edges can be split
        low = cut(_minima(both).withColumn("m", F.least("c", "m")))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(_minima(large), F.col("u") == F.col("c"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        new_state = _state(new)
        drop_cut(now)
        drop_cut(low)
        now, done = new, new_state == state
        state = new_state
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
