"""Folder audits: from a listing of paths to observations and summaries."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy_null
from .numbering import numbered

#: Suffixes of images and videos.
IMAGES = (".heic", ".jpeg", ".jpg", ".png", ".webp")
VIDEOS = (".avi", ".m4v", ".mkv", ".mov", ".mp4")
#: Top folders that are no stores.
INTERNAL = ("backend", "data", "docs", "mobile", "reports", "sku_exact_areas", "sku_uncertain_areas")
STATUS_ORDER = ("ok", "pending", "warning", "retake")


def suffix(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def media_kind(path: str = "path") -> Column:
    s = suffix(path)
    return F.when(s.isin(*IMAGES), "image").when(s.isin(*VIDEOS), "video").otherwise("unsupported")


def parts(path: str = "path") -> Column:
    return F.filter(F.split(F.col(path), "/"), lambda p: p != "")


def role(path: str = "path") -> Column:
    """By words in the file's stem, the first of these that is there."""
    stem = F.regexp_replace(F.lower(F.element_at(parts(path), -1)), r"\.[^.]*$", "")
    return (
        F.when(stem.contains("contact_sheet"), "contact_sheet")
        .when(stem.contains("overview"), "overview")
        .when(stem.contains("zone"), "zone_crop")
        .otherwise("source_image")
    )


def zone(path: str = "path", exact: str = "sku_exact_areas", uncertain: str = "sku_uncertain_areas") -> Column:
    low = F.transform(parts(path), F.lower)
    return F.when(F.array_contains(low, exact), "exact").when(F.array_contains(low, uncertain), "uncertain").otherwise("unknown")


def store(path: str = "path", internal: tuple[str, ...] = INTERNAL, fallback: Column | None = None) -> Column:
    """The first folder of a relative path of two parts or more that is not internal."""
    p = parts(path)
    own = F.when((F.size(p) >= 2) & ~F.get(p, F.lit(0)).isin(*internal), F.get(p, F.lit(0)))
    return own if fallback is None else F.coalesce(own, fallback)


def evidence(paths: DataFrame, path: str = "path") -> DataFrame:
    """Images outside report folders with role, zone and store, numbered by path."""
    kept = paths.where((media_kind(path) == "image") & ~F.array_contains(parts(path), "reports")).select(F.col(path).alias("path"))
    return kept.select("path", role("path").alias("role"), zone("path").alias("zone_type"), store("path").alias("store_name"))


def observe(ev: DataFrame) -> DataFrame:
    """One observation for each piece of evidence, by the first rule that holds."""
    review = F.col("role").isin("contact_sheet", "overview")

    def pick(a, b, c, d, e):
        return (
            F.when(review, a).when(F.col("zone_type") == "exact", b).when(F.col("zone_type") == "uncertain", c).when(falsy_null("store_name").isNotNull(), d).otherwise(e)
        )

    return numbered(ev, ["path"], "_n").select(
        F.format_string("obs_%06d", "_n").alias("observation_id"),
        "path",
        "role",
        "zone_type",
        "store_name",
        pick(F.lit("not_product"), F.lit("brand_only"), F.lit("needs_retake"), F.lit("pending_analysis"), F.lit("unknown")).alias("status"),
        pick(F.lit(1.0), F.lit(0.35), F.lit(0.9), F.lit(0.0), F.lit(0.0)).alias("confidence"),
        pick(
            F.concat("role", F.lit(" is for review and is not counted as a product.")),
            F.lit("Exact-count area; recognition is not connected."),
            F.lit("Uncertain area: retake or review by hand."),
            F.lit("Store photo queued for detection and recognition."),
            F.lit("Unknown folder; classify by hand."),
        ).alias("note"),
    )


def store_summaries(ev: DataFrame) -> DataFrame:
    return ev.where(falsy_null("store_name").isNotNull()).groupBy("store_name").agg(F.count(F.lit(1)).alias("image_count")).orderBy("store_name")


def audit_summary(obs: DataFrame) -> DataFrame:
    n, s, z, r = F.count_if, F.col("status"), F.col("zone_type"), F.col("role")
    has_store = falsy_null("store_name").isNotNull()
    return obs.agg(
        F.count(F.lit(1)).alias("total_evidence_files"),
        F.countDistinct(falsy_null("store_name")).alias("store_count"),
        n(has_store).alias("market_photo_files"),
        n(z == "exact").alias("exact_zone_files"),
        n(z == "uncertain").alias("uncertain_zone_files"),
        n(r == "zone_crop").alias("countable_zone_files"),
        n(r.isin("contact_sheet", "overview")).alias("review_artifact_files"),
        n(s.isin("recognized", "brand_only")).alias("recognized_observations"),
        n(s == "pending_analysis").alias("pending_analysis_observations"),
        n(s == "needs_retake").alias("needs_review_observations"),
        n(s == "unknown").alias("unknown_observations"),
    )


def worse(a: Column, b: Column) -> Column:
    """The later of two states in the order of severity."""
    names = F.array(*map(F.lit, STATUS_ORDER))
    return F.element_at(names, F.greatest(F.array_position(names, a), F.array_position(names, b)).cast("int"))


def quality_status(width="width", height="height", brightness="brightness", contrast="contrast", sharpness="sharpness") -> tuple[Column, Column]:
    """(status, issues): rules applied in order, a later one may overrule."""
    low = (F.col(width) > 0) & (F.col(height) > 0) & (F.least(width, height) < 900)
    dark, bright = F.col(brightness) < 45, F.col(brightness) > 225
    flat, blurred = F.col(contrast) < 22, F.col(sharpness) < 5.0
    state = F.when(low, "warning").otherwise("ok")
    state = F.when(dark, "retake").when(bright, "warning").otherwise(state)
    state = F.when(flat, worse(state, F.lit("warning"))).otherwise(state)
    state = F.when(blurred, "retake").otherwise(state)
    found = F.filter(
        F.array(
            F.when(low, "low_resolution"), F.when(dark, "too_dark").when(bright, "very_bright"), F.when(flat, "low_contrast"), F.when(blurred, "blurred")
        ),
        lambda x: x.isNotNull(),
    )
    return state, F.when(F.size(found) == 0, F.array(F.lit("acceptable"))).otherwise(found)


def video_issues(duration="duration_seconds") -> Column:
    return F.filter(F.array(F.lit("queued"), F.when(F.col(duration) > 90, "long_video")), lambda x: x.isNotNull())


def media_summary(media: DataFrame) -> DataFrame:
    n, k, s = F.count_if, F.col("media_kind"), F.col("quality_status")
    return media.agg(
        F.count(F.lit(1)).alias("total"),
        *[n(k == x).alias(x) for x in ("image", "video", "unsupported")],
        *[n(s == x).alias(x) for x in STATUS_ORDER],
        n(s.isin("ok", "warning", "pending")).alias("ready"),
        F.array_join(F.sort_array(F.collect_set(falsy_null("store_name"))), ",").alias("stores"),
    )


def job_notes(retake: Column, videos: Column) -> Column:
    return F.filter(
        F.array(F.lit("received"), F.lit("recognition_queued"), F.when(retake > 0, "retake_needed"), F.when(videos > 0, "video_queued")), lambda x: x.isNotNull()
    )


def report_digests(listing: DataFrame, root: str, path: str) -> DataFrame:
    """``report_id`` of each ``root``: a digest of the root and its sorted paths, run together.

    Paths pass through one running hash in order, so a long listing is sorted (and
    spilled) but never held; null paths are left out, a null root has a null id."""

    def fold(it):
        now, digest = None, None

        def ended():
            name = None if now is None else "report_" + digest.hexdigest()[:12]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([name], pa.string())], [root, "report_id"])

        for batch in it:
            for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or r != now:
                    if digest is not None:
                        yield ended()
                    now, digest = r, hashlib.sha256((r or "").encode())
                digest.update((p or "").encode())
        if digest is not None:
            yield ended()

    rows = listing.select(F.col(root).cast("string").alias(root), F.col(path).cast("string").alias("_path"))
    return rows.repartition(root).sortWithinPartitions(root, "_path").mapInArrow(fold, f"`{root}` string, report_id string")
