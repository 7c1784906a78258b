"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .written import written


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """``df`` with 1-based numbers in ``order``: rows are dealt out by ranges of it
    and numbered in each; sizes of earlier ranges are added.  The ranges are
    sampled, so they are written once before anything is counted."""
    pid, inner = "_shelfspark_range", "_shelfspark_row"
    ranged = written(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()))
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy(F.col(pid).alias("p")).agg(F.count(F.lit(1)).alias("c")).select("p", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("start"))
    within = ranged.withColumn(inner, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
    joined = within.join(F.broadcast(starts), F.col(pid) == F.col("p"))  # as many rows as ranges
    return joined.withColumn(name, F.col("start") + F.col(inner)).drop(pid, inner, "p", "start")
