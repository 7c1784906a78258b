"""Streams run over the driver's files to their end; results equal the batch ones."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.ledger import Ledger, write_batches
from ..streaming import live
from ..streaming import tracks as streamed
from .audit_queries import _DETS, _detections
from .box_queries import _FEEDBACK, _GRID, _views, feedback_events, live_detections
from ..operators.written import shared_dir
from .registry import query, table


def _staged(spark: SparkSession, rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The rows as files of one session's order each, read back as a stream."""
    base = _folder(spark) + f"/stream-{uuid.uuid4().hex}"
    rows.repartition(key).sortWithinPartitions(key).write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{base}/in"), base


def _folder(spark: SparkSession) -> str:
    return shared_dir(spark)


def _finish(stream: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """Run to the end; in append mode through files, else the last complete batch."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(f"WITH {_GRID} SELECT * FROM cells")
def stream_grid(spark, sf_dir):
    stream, base = _staged(spark, _views(spark, sf_dir), "session_id")
    return _finish(live.mark_cells(stream), base, "complete")


@query()
def stream_sessions(spark, sf_dir):
    rows = live_detections(spark, sf_dir)
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("seq")))  # a frame a second
    stream, base = _staged(spark, timed, "session_id")
    return _finish(live.track_stream(stream, "ts"), base)


@query(_FEEDBACK)
def stream_feedback(spark, sf_dir):
    stream, base = _staged(spark, feedback_events(spark, sf_dir), "session_id")
    return _finish(live.feedback_stream(stream), base)


@query("SELECT user_id AS job_id, arg_max(event_type, ts) AS sku_status, max(ts) AS ts FROM events GROUP BY 1")
def stream_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("sku_status"), "ts")
    stream, base = _staged(spark, rows, "job_id")
    return _finish(live.job_states(stream), base, "complete")


class Killed(Exception):
    """Stands for a writer that ends between staging and commit."""


def _in_order(spark: SparkSession, rows: DataFrame, key: str, parts: int) -> tuple[DataFrame, str]:
    """The rows as ``parts`` batches of files by ranges of ``key``, read back as a stream of one range after another."""
    base = _folder(spark) + f"/stream-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(key), F.max(key)).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    for i in range(parts):
        at = (low or 0) + i * step
        rows.where((F.col(key) >= at) & (F.col(key) < at + step)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), base


@query("SELECT event_id, user_id, event_type, round(value * 2, 4) AS twice FROM events")
def resumed_batches(spark, sf_dir):
    """Events written batch by batch by a writer that is killed after staging its second and started again."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    stream, base = _in_order(spark, rows, "event_id", 4)

    def twice(batch: DataFrame) -> DataFrame:
        return batch.select("event_id", "user_id", "event_type", F.round(F.col("value") * 2, 4).alias("twice"))

    def kill(name: str) -> None:
        if name == "batch-000000001":
            raise Killed(name)

    first = write_batches(stream, f"{base}/out", f"{base}/ckpt", twice, kill)
    try:
        first.awaitTermination()
    except StreamingQueryException as e:
        if "Killed" not in str(e):
            raise
    write_batches(stream, f"{base}/out", f"{base}/ckpt", twice).awaitTermination()
    return Ledger(spark, f"{base}/out").read(twice(rows).schema)


GAP = 5000


@query(
    f"""WITH {_DETS},
a AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > {GAP} THEN 1 ELSE 0 END AS cut FROM d WINDOW w AS (PARTITION BY video, track_id ORDER BY frame)),
b AS (SELECT *, sum(cut) OVER (PARTITION BY video, track_id ORDER BY frame) AS piece FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY video, track_id, piece ORDER BY quality DESC, frame) AS place FROM b)
SELECT CAST(video AS VARCHAR) AS video, track_id, count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame, max(conf) AS peak_conf,
  arg_min(frame, place) AS best_frame, string_agg(frame, ',' ORDER BY place) FILTER (WHERE place <= 3) AS crop_frames
FROM c GROUP BY video, track_id, piece HAVING count(*) >= 3 AND max(conf) >= 0.35"""
)
def stream_tracks(spark, sf_dir):
    """Tracks and their three best crops from a stream of detections; a rest of more than ``GAP`` frames ends one."""
    rows = _detections(spark, sf_dir).select(F.col("video").cast("string").alias("video"), "track_id", "frame", "conf", "quality")
    end = rows.agg((F.coalesce(F.max("frame"), F.lit(0)) + 2 * GAP).alias("frame"))  # time goes on after the last detection
    ended = end.select(F.lit("").alias("video"), F.lit(-1).cast("long").alias("track_id"), "frame", F.lit(0.0).alias("conf"), F.lit(0.0).alias("quality"))
    stream, base = _in_order(spark, rows.unionAll(ended), "frame", 4)
    streamed.tracks_of_files(stream, f"{base}/out", f"{base}/ckpt", GAP, k=3).awaitTermination()
    out = Ledger(spark, f"{base}/out").read(StructType.fromDDL(streamed.OUT))
    return out.withColumn("crop_frames", F.array_join(F.transform("crops", lambda c: c["frame"].cast("string")), ",")).drop("crops")
