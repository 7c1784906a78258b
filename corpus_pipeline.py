"""The corpus pipeline: filter by quality, keep one of near copies, hide
secrets, pack into training sequences.

Each stage takes all that its predecessor kept and its decisions take effect.
The quality models are fitted on the labelled rows of the tables in ``sf_dir``,
not on what earlier stages left of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import jaccard_join, packing, quality_classifier, quality_rules, secret_scan
from shelfspark.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.filter_quality(docs, model)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.filter_rules(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "n_loss")


STAGES = [
    ("quality_classifier", quality_stage),
    ("quality_rules", rules_stage),
    ("jaccard_join", jaccard_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The quality models and packing cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
