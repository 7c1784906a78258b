"""Operator 6: sharding by proportional stratified interleaving, JVM side only.

Rows are shuffled within their source by a seeded hash; the row of rank r among
the n of its source gets the fractional rank (r - 1/2) / n.  Sorted by that, any
stretch of rows holds the sources in the mixture's proportions, so the sorted
order is cut into shards whose row counts differ by one at most (law ``rows``).

No sort runs over one source or over all rows in one task: ranks are counted in
ranges of the hash and of the fractional rank, whose sizes are summed up from
small tables.  There are as many ranges as the rows ask for; shards and slots do
not depend on their number.

Defined results: null text has no bytes; a null source is a source of its own;
repeated rows each take a slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, place

SHARDS = 24
SEED = "shards-1"
#: Least number of ranges, as a power of two, of the hash within a source and of the
#: fractional rank; and rows in one of them, about, which decides from there on.
HASH_BITS = 10
RANGE_BITS = 12
RANGE_ROWS = 1 << 18


def range_bits(rows: int, least: int) -> int:
    """Bits of as many ranges as keep ``RANGE_ROWS`` in each, one source holding all rows or not."""
    return max(least, (max(rows, 1) // RANGE_ROWS).bit_length())


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row."""
    named, i = by_place(docs), F.col(place(docs, id_col))
    text = F.coalesce(F.col(place(docs, text_col)).cast("string"), F.lit(""))
    stratum, ident = F.col(place(docs, stratum_col)), i.cast("string")
    n = docs.count()
    hash_bits, ranges = range_bits(n, HASH_BITS), 1 << range_bits(n, RANGE_BITS)
    keyed = named.select(
        i.alias("_id"),
        text.alias("_text"),
        F.when(stratum.isNull(), "n").otherwise(F.concat(F.lit("s"), stratum.cast("string"))).alias("_src"),
        F.when(ident.isNull(), F.xxhash64(F.lit(seed), text)).otherwise(F.xxhash64(F.lit(seed), ident)).alias("_h"),
    ).withColumn("_range", F.shiftright("_h", 64 - hash_bits))

    sizes = keyed.groupBy("_src", "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(
        F.col("_src").alias("_s"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_src")).alias("_of"),
    )
    rows = keyed.select(
        "_id", "_src", "_h", "_range", (F.octet_length("_text").cast("long") + 8).alias("size"), F.crc32(F.col("_text").cast("binary")).alias("text_crc32")
    )
    within = Window.partitionBy("_src", "_range").orderBy("_h", "_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("_k", F.row_number().over(within))
        .join(sums, (F.col("_src") == F.col("_s")) & (F.col("_range") == F.col("_r")))
        .select("_id", "_src", "_h", "size", "text_crc32", ((F.col("_before") + F.col("_k") - 0.5) / F.col("_of")).alias("_frac"))
        .withColumn("_part", F.least(F.floor(F.col("_frac") * ranges), F.lit(ranges - 1)).cast("int"))
    )

    counted = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    starts = counted.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_m").over(order), F.lit(0)).alias("_start"),
        F.sum("_m").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    within = Window.partitionBy("_part").orderBy("_frac", "_src", "_h", "_id", "text_crc32", "size")
    placed = (
        ranked.withColumn("_j", F.row_number().over(within))
        .join(F.broadcast(starts), F.col("_part") == F.col("_p"))  # a row for each range, one in RANGE_ROWS of all
        .withColumn("_at", F.col("_start") + F.col("_j") - 1)
        .withColumn("_shard", F.expr(f"_at * {shards} div _all"))
    )
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_at - (_shard * _all + {shards - 1}) div {shards}").alias("slot"),
    )
