"""Tracks from detections and merged objects from tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track_aggregate(detections: DataFrame, keys: list[str], min_frames: int = 3, min_peak: float = 0.35) -> DataFrame:
    """Span, frames and peak confidence of each track that lasts and is sure enough."""
    return (
        detections.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_frames"),
            F.min("frame").alias("first_frame"),
            F.max("frame").alias("last_frame"),
            F.max("conf").alias("peak_conf"),
            F.min_by("frame", F.struct(-F.col("quality"), "frame")).alias("best_frame"),
        )
        .where((F.col("n_frames") >= min_frames) & (F.col("peak_conf") >= min_peak))
    )


def top_crops(detections: DataFrame, keys: list[str], k: int, score: str = "quality", order: str = "frame") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), order))
    return detections.withColumn("rank", n).where(F.col("rank") <= k)


def merged_objects(tracks: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """One object for each component of tracks (``ord``, ``root``): the surest
    track represents it; objects are numbered by their root."""
    joined = tracks.join(roots.withColumnRenamed("node", "ord"), [key, "ord"]) if key in roots.columns else tracks.join(roots.withColumnRenamed("node", "ord"), "ord")
    ids = F.sort_array(F.collect_list(F.struct((-F.col("peak_conf")).alias("c"), "ord", "track_id")))
    out = joined.groupBy(key, "root").agg(
        F.min_by("track_id", F.struct(-F.col("peak_conf"), "ord")).alias("rep_track_id"),
        F.max("peak_conf").alias("peak_conf"),
        F.transform(ids, lambda s: s["track_id"]).alias("track_ids"),
    )
    return out.withColumn("object_id", F.row_number().over(Window.partitionBy(key).orderBy("root")))


def live_quality(area, side, sharp, recognized, conf, guard):
    """State of a live box by the first rule that holds."""
    return (
        F.when((area < 0.026) | (side < 0.115), "FAR")
        .when(sharp < 0.34, "BLUR")
        .when(~recognized | (conf < 0.70) | (guard < 0.88) | (sharp < 0.44), "UNCERTAIN")
        .otherwise("GOOD")
    )


def live_background(chroma, std, edges, area):
    return ((chroma < 22) & (std < 15)) | ((edges < 0.035) & (std < 24)) | ((area > 0.12) & (edges < 0.055) & (std < 34.8))


def live_hint(todo, closer, blur, aim, hold, captured):
    return (
        F.when((todo == 0) & (captured > 0), "zone_done")
        .when(todo == 0, "point_at_shelf")
        .when(closer > 0, "closer")
        .when(blur > 0, "slower")
        .when(aim > 0, "aim")
        .when(hold > 0, "hold")
        .otherwise("move_on")
    )


def guard_bucket(prob, det):
    return F.when(prob >= 0.90, "positive").when((det >= 0.30) & (prob <= 0.18), "hard_negative").otherwise("review")


def cell_state(frames, best):
    """good from a sharpness of .55, else poor, none without frames."""
    return F.when(frames == 0, "none").when(best >= 0.55, "good").otherwise("poor")
