"""The labelled rows that the two quality models learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import by_place, id_text, place

#: Remainder of crc32(doc_id as text) by 3 that marks a held-out document.
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str | Column = "doc_id") -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int, seed: str, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """At most ``most`` labelled rows that are not held out, the first by a hash
    of their id: ``_id``, ``_text``, ``_label``, and ``_fold`` from 0 to 3.

    Ids with several labels take the smallest, repeated documents the smallest text.
    Where only one table has text as ids, text that is no id of the other's kind meets none.
    """
    named = by_place(labels).select(F.col(place(labels, id_col)).alias("_id"), F.col(place(labels, label_col)).cast("double").alias("_label"))
    texts = id_text(docs, id_col, text_col)
    kind, label_kind = texts.schema["_id"].dataType, named.schema["_id"].dataType
    met = F.col("_id")
    if kind != label_kind and isinstance(label_kind, StringType):
        named = named.withColumn("_id", F.col("_id").try_cast(kind))
    elif kind != label_kind and isinstance(kind, StringType):
        texts, met = texts.where(~held_out("_id")), met.try_cast(label_kind)  # "017" and 17 may differ in that
    ids = (
        named.where(F.col("_id").isNotNull() & F.col("_label").isin(0.0, 1.0) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id").cast("string")))
        .orderBy("_order", "_id")
        .limit(most)
        .withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed + "fold"), F.col("_id").cast("string")), F.lit(4)).cast("int"))
    )
    # the sample has ``most`` rows of ids at most, which bounds what is broadcast
    found = texts.withColumn("_met", met).join(F.broadcast(ids.drop("_order").withColumnRenamed("_id", "_met")), "_met")
    return found.groupBy("_id", "_label", "_fold").agg(F.min("_text").alias("_text")).select("_id", "_text", "_label", "_fold")
