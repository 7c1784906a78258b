"""Tracks folded from a stream of detections, emitted when they have ended.

State of 64 consecutive track numbers of a video: one value with those that are open,
each with its sums and its best crops, as a call to the state takes far longer than
the rows it is made for.  An event-time timer looks for tracks whose last frame is ``gap`` frames ago.  What a
track holds does not grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = (
    "video string, track_id long, n_frames long, first_frame long, last_frame long, peak_conf double,"
    " best_frame long, crops array<struct<score: double, frame: long>>"
)
_Track = Row("video", "track_id", "n_frames", "first_frame", "last_frame", "peak_conf", "best_frame", "crops")


#: A video's tracks go together by their number without so many last bits.
PART_BITS = 6
OPEN = "at long, tracks array<struct<track: long, n: long, first: long, last: long, peak: double, crops: array<struct<score: double, frame: long>>>>"


class TrackFold(StatefulProcessor):
    """Sums and best crops of some tracks of a video; a rest of more than ``gap`` frames ends one,
    and rows after that begin another track of the same number."""

    def __init__(self, gap: int, k: int, min_frames: int, min_peak: float):
        self.gap, self.k, self.min_frames, self.min_peak = gap, k, min_frames, min_peak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", OPEN)

    def _ended(self, key, track, n, first, last, peak, crops) -> Iterator[Row]:
        if n >= self.min_frames and peak >= self.min_peak:
            yield _Track(key[0], track, n, first, last, peak, crops[0][1], [Row(score=s, frame=f) for s, f in crops])

    def _held(self):
        """When the timer is due, and the open tracks: sums and crops by number."""
        held = self.sums.get()
        return (None, {}) if held is None else (held[0], {t: ((n, first, last, peak), [tuple(c) for c in crops]) for t, n, first, last, peak, crops in held[1]})

    def _hold(self, at, tracks) -> None:
        """``at`` is None if no timer is due: one is set for the first track that may end.  A track
        that goes on meanwhile leaves it, and the timer sets the next one."""
        if at is None:
            at = (min(sums[2] for sums, _ in tracks.values()) + self.gap) * 1000
            self.handle.registerTimer(at)
        self.sums.update((at, [(t, *sums, crops) for t, (sums, crops) in tracks.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, tracks = self._held()
        for track, frame, conf, quality in sorted((r["track_id"], r["frame"], r["conf"], r["quality"]) for r in rows):
            sums, crops = tracks.get(track, (None, []))
            if sums and frame - sums[2] > self.gap:
                yield from self._ended(key, track, *sums, crops)
                sums, crops = None, []
            if sums and sums[1] - frame > self.gap:  # out of order by more than a rest: a track of its own
                yield from self._ended(key, track, 1, frame, frame, conf, [(quality, frame)])
                continue
            n, first, last, peak = sums or (0, frame, frame, conf)
            sums = (n + 1, min(first, frame), max(last, frame), max(peak, conf))
            if len(crops) < self.k or (-quality, frame) < (-crops[-1][0], crops[-1][1]):
                crops = sorted([*crops, (quality, frame)], key=lambda c: (-c[0], c[1]))[: self.k]
            tracks[track] = sums, crops
        self._hold(at, tracks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, tracks = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        for track, (sums, crops) in list(tracks.items()):
            if (sums[2] + self.gap) * 1000 <= now:
                yield from self._ended(key, track, *sums, crops)
                del tracks[track]
        if tracks:
            self._hold(None, tracks)
        else:
            self.sums.clear()

    def close(self) -> None:
        pass


def fold_tracks(detections: DataFrame, gap: int, k: int = 8, min_frames: int = 3, min_peak: float = 0.35, delay: int = 0) -> DataFrame:
    """A stream of ``video``, ``track_id``, ``frame``, ``conf``, ``quality`` to its
    tracks, each when the watermark (``delay`` frames behind) passes its end.

    A frame is a second of event time.  Rows behind the watermark that the batch
    before had reached are late and left out; rows without a frame or a track belong to none, and one without confidence
    or quality counts with 0."""
    known = detections.where("video IS NOT NULL AND track_id IS NOT NULL AND frame IS NOT NULL")
    rows = known.select(
        F.col("video").cast("string").alias("video"),
        F.col("track_id").cast("long").alias("track_id"),
        F.col("frame").cast("long").alias("frame"),
        F.coalesce(F.col("conf").cast("double"), F.lit(0.0)).alias("conf"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("quality"),
        F.timestamp_seconds("frame").alias("ts"),
    )
    timed = rows.withWatermark("ts", f"{delay} seconds")
    return timed.withColumn("part", F.shiftright("track_id", PART_BITS)).groupBy("video", "part").transformWithState(TrackFold(gap, k, min_frames, min_peak), OUT, "Append", "EventTime")


def started(writer):
    """Start a stream whose operators keep their state by column families, which needs that store."""
    conf = writer._spark.conf
    was = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return writer.start()
    finally:
        conf.set(PROVIDER, was) if was else conf.unset(PROVIDER)


def tracks_of_files(stream: DataFrame, folder: str, checkpoint: str, gap: int, **limits):
    """Fold a stream of detections into a ledger of ended tracks."""
    from ..sources.ledger import Ledger

    ledger = Ledger(stream.sparkSession, folder)
    ledger.drop_staged()

    def each(batch: DataFrame, n: int) -> None:
        ledger.put(batch, f"batch-{n:09d}")

    tracks = fold_tracks(stream, gap, **limits)
    return started(tracks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True))
