"""Command line: ``spark-submit shelfspark/cli.py VERB ...`` (or ``python -m shelfspark.cli``)."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import folder
from .sources import docx, readers, reports


@dataclass(frozen=True)
class AuditConfig:
    """Parameters of a video audit; thresholds of the operators by name."""

    detector_conf: float = 0.35
    min_frames: int = 4
    review_conf: float = 0.75
    similarity: float = 0.86
    min_gap_frames: int = 12
    rotation_sample: int = 8
    retry_objects: int = 10


def audit_images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, summary, lines of the report) of an image folder."""
    paths = readers.media_files(spark, root, exclude_first=(), exclude_any=("reports",)).select("path")
    obs = folder.observe(folder.evidence(paths))
    summary = folder.audit_summary(obs)
    shown = obs.where("status <> 'not_product'").withColumn("conf", F.format_string("%.2f", "confidence"))
    text = reports.document(
        "Image audit",
        [
            reports.totals_lines(summary, summary.columns, "Summary"),
            reports.markdown_table(folder.store_summaries(obs), {"store_name": "Store", "image_count": "Images"}, [F.col("store_name")], "Stores"),
            reports.markdown_table(shown, {"observation_id": "Id", "path": "Path", "status": "Status", "conf": "Confidence"}, [F.col("observation_id")], "Observations"),
        ],
    )
    return obs, summary, text


def create_job(spark: SparkSession, root: str, store: str | None = None) -> DataFrame:
    """One job row with its media counted, and its notes."""
    media = readers.media_files(spark, root).withColumn("media_kind", folder.media_kind()).withColumn("store_name", folder.store(fallback=F.lit(store)))
    counted = folder.media_summary(media.withColumn("quality_status", F.lit("pending")))
    return counted.select(
        F.concat(F.lit("job_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)).alias("job_id"),
        F.current_timestamp().alias("created_at"),
        F.lit("completed").alias("status"),
        F.lit("pending").alias("sku_status"),
        F.lit(root).alias("source"),
        "*",
        folder.job_notes(F.col("retake"), F.col("video")).alias("notes"),
    )


def find_videos(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first path of each wanted video by its name; null where there is none."""
    first = listing.groupBy(readers.base_name("path").alias("video")).agg(F.min("path").alias("path"))
    return wanted.join(first, "video", "left")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="shelfspark")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, args in {"audit-images": ("root", "out"), "import-docx-catalog": ("path", "out"), "create-job": ("root", "out")}.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        v.add_argument("--competitor", action="store_true")
        v.add_argument("--store")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("shelfspark").getOrCreate()
    if a.verb == "audit-images":
        obs, summary, text = audit_images(spark, a.root)
        reports.write_json(obs, f"{a.out}/observations")
        reports.write_json(summary, f"{a.out}/summary")
        reports.write_document(text, f"{a.out}/report")
    elif a.verb == "import-docx-catalog":
        from .operators.catalog import export_rows, unique_ids

        rows = unique_ids(docx.products(docx.read_body(spark, a.path), is_own=not a.competitor))
        reports.write_csv(export_rows(rows).drop("path", "ord"), a.out)
    else:
        create_job(spark, a.root, a.store).write.mode("append").json(a.out)


if __name__ == "__main__":
    main()
