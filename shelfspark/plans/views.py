"""The driver's tables seen as shelf-audit tables, in DataFrames and in SQL.

Order columns come from all columns of a row, so rows that tie are equal and
their order cannot matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

CATALOG_SQL = """
catalog AS (
  SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS sku_id, p_brand AS brand, p_type AS category, p_name AS model,
    CAST(p_size AS VARCHAR) || '/' || CAST(p_partkey % 97 AS VARCHAR) || '/' || CAST(p_partkey AS VARCHAR) AS article_codes
  FROM part)"""

ITEMS_SQL = f"""{CATALOG_SQL},
items AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS video, CAST(l_suppkey AS BIGINT) AS video_ord,
    (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS object_id,
    CASE l_returnflag WHEN 'A' THEN 'matched_sku' WHEN 'N' THEN 'brand_only' ELSE 'unknown' END AS status,
    (l_suppkey + l_partkey) % 2 = 1 AS is_own, c.brand, c.model, c.category, c.sku_id, c.article_codes,
    round(0.5 + 5 * CAST(l_discount AS DOUBLE), 6) AS ocr_conf,
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS crop, l_linestatus AS method
  FROM lineitem JOIN catalog c ON c.ord = l_partkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("ord"),
        key.cast("string").alias("sku_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("model"),
        F.concat_ws("/", F.col("p_size").cast("string"), (key % 97).cast("string"), key.cast("string")).alias("article_codes"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    cat = catalog(spark, sf_dir)
    ident = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    return line.join(cat.withColumnRenamed("ord", "l_partkey"), "l_partkey").select(
        F.col("l_suppkey").cast("string").alias("video"),
        F.col("l_suppkey").cast("long").alias("video_ord"),
        ident.alias("ord"),
        ident.alias("object_id"),
        F.when(F.col("l_returnflag") == "A", "matched_sku").when(F.col("l_returnflag") == "N", "brand_only").otherwise("unknown").alias("status"),
        ((F.col("l_suppkey") + F.col("l_partkey")) % 2 == 1).alias("is_own"),
        "brand",
        "model",
        "category",
        "sku_id",
        "article_codes",
        F.round(F.lit(0.5) + F.col("l_discount").cast("double") * 5, 6).alias("ocr_conf"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("crop"),
        F.col("l_linestatus").alias("method"),
    )
