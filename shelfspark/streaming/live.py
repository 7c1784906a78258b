"""Live capture: a tracker per session, the coverage grid, the feedback buffer
and job states, in batch and as streams.

The tracker's and buffer's rules need the whole past of a session in order, so a
session's state is one value of the state store, bounded by the rules
themselves (tracks and candidates are capped and expire).
"""

from __future__ import annotations

import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import grid_cells
from ..functions.pixels import motion_udf
from ..functions.vectors import feedback_rank
from ..operators.tracks import cell_state
from ..operators.written import spread
from ..sources.ledger import Ledger, write_batches
from .tracker import BOX, CAPTURE_AT, SMOOTH_BOX, LiveTracker, replay, whole_frames

JOB_OUT = "job_id string, sku_status string, sku_report string, note string"
#: Age and number of feedback candidates, and how old the best may be.
FEEDBACK_MS, FEEDBACK_MOST, FEEDBACK_RECENT_MS = 8000, 24, 1400

FRAME_OUT = "session_id string, seq long, n_detections long, n_visible long, n_captured long, n_retake long, n_tracked long"
FRAME_ARROW = pa.schema([("session_id", pa.string()), *[(c.split()[0], pa.int64()) for c in FRAME_OUT.split(", ")[1:]]])
FRAME_NAMES = FRAME_ARROW.names


def _seen(detections: DataFrame, *more: str | None) -> DataFrame:
    """Just what the tracker reads, a frame's rows of one kind of number; rows without a frame are left out."""
    numbers = [F.col(c).cast("double").alias(c) for c in (*BOX, "conf")]
    keys = [F.col("session_id").cast("string").alias("session_id"), *[F.col(c).cast("long").alias(c) for c in ("seq", "ord")]]
    return detections.where("seq is not null").select(*keys, *numbers, "recognized", "signature", *filter(None, more))


def track_batch(detections: DataFrame) -> DataFrame:
    """Counters of each frame; a row of negative or null ``ord`` stands for a frame without detections.

    Sessions are dealt out and sorted; frames stream past one tracker, so a task holds
    the tracks of one session and a batch of rows, however long the session is."""

    def run(batches):
        tracker, session = LiveTracker(), None
        for part in whole_frames(batches):
            out = []
            for row, tracker in replay(part, tracker, session):
                session = row[0]
                out.append(row)
            yield pa.RecordBatch.from_pydict(dict(zip(FRAME_NAMES, map(list, zip(*out)))), schema=FRAME_ARROW)

    return spread(_seen(detections), "session_id").sortWithinPartitions("session_id", "seq", "ord").mapInArrow(run, FRAME_OUT)


#: How long a session may rest before its state is dropped.
IDLE_MS = 30 * 60 * 1000


def track_stream(detections: DataFrame, ts: str | None = None, idle_ms: int = IDLE_MS, watermark: str = "10 seconds") -> DataFrame:
    """The same over a stream; a row of ``ord`` -2 resets its session.

    Frames of one batch are taken in order; a frame that comes after a later one
    of its session was counted is late and left out.  A session's state goes when
    it has rested for ``idle_ms`` of event time, which column ``ts`` has; without
    one it stays (a timeout by the clock would keep a finite run from ending)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        g = pd.concat(list(parts)).sort_values(["seq", "ord"], kind="stable")
        tracker, last = LiveTracker(), None
        if state.exists:
            text, last = state.get
            tracker = LiveTracker.load(text)
        newest = max(int(g["seq"].max()), -1 if last is None else last)
        if last is not None:
            g = g[g["seq"] > last]
        if (g["ord"] == -2).any():
            tracker, g = LiveTracker(), g[g["seq"] > g[g["ord"] == -2]["seq"].max()]
        if len(g):
            rows = pa.Table.from_pandas(g.drop(columns=[ts] if ts else []), preserve_index=False)
            yield pd.DataFrame([row for row, _ in replay(rows, tracker, rows.column("session_id")[0].as_py())], columns=FRAME_NAMES)
        state.update((tracker.dump(), newest))
        if ts is not None:
            now = state.getCurrentWatermarkMs()
            at = int(pd.Timestamp(g[ts].max()).timestamp() * 1000) if len(g) else now
            state.setTimeoutTimestamp(max(at + idle_ms, now + 1))

    rows = _seen(detections, ts)
    timed = rows.withWatermark(ts, watermark) if ts else rows
    kind = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return timed.groupBy("session_id").applyInPandasWithState(run, FRAME_OUT, "tracker string, last long", "append", kind)


def mark_cells(frames: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Cells of the coverage grid seen by frames (``cx``, ``cy``, ``sharpness``):
    a plain aggregation, which streams in update mode as it is."""
    cells = frames.select(*keys, "sharpness", F.explode(grid_cells("cx", "cy")).alias("c"))
    seen = cells.groupBy(*keys, "c.col", "c.row").agg(F.count(F.lit(1)).alias("frames"), F.max("sharpness").alias("best_sharpness"))
    return seen.withColumn("state", cell_state(F.col("frames"), F.col("best_sharpness")))


def grid_state(cells: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.count_if(F.col("state") == "good").alias("good"),
        F.count_if(F.col("state") == "poor").alias("poor"),
        *[f(c).alias(f"{n}_{c}") for c in ("col", "row") for n, f in (("min", F.min), ("max", F.max))],
    )


def nearest_poor(cells: DataFrame, views: DataFrame, key: str = "session_id", cell: float = 0.25) -> DataFrame:
    """From the centre of each session's view to the nearest poor cell, the first by column and row of equals."""
    poor = cells.where(F.col("state") == "poor").join(views, key)
    dx = (F.col("col") + 0.5) * cell - (F.col("cx") + 0.5)
    dy = (F.col("row") + 0.5) * cell - (F.col("cy") + 0.5)
    near = poor.select(key, dx.alias("dx"), dy.alias("dy"), "col", "row")
    best = F.min(F.struct((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d"), "col", "row", "dx", "dy"))
    return near.groupBy(key).agg(best.alias("b")).select(key, "b.col", "b.row", "b.dx", "b.dy")


def camera_offset(frames: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Running offset from shifts: the window moves against the picture."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumns(
        {"cx": -F.sum("dx").over(w), "cy": F.sum("dy").over(w), "speed": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))}
    )


#: The camera's angles, and the least confidence in a match of pictures.
H_ANGLE, V_ANGLE, LEAST_MATCH = 1.10, 0.85, 0.25


def motion(frames: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Shift of every frame against the one before (``luma``, ``h``, ``w``, ``rotation``)
    with ``cx``, ``cy`` and ``speed``: by matching blocks, or where that is too unsure
    by the turn (``dyaw``, ``dpitch``); a first frame, or one of another size, has none."""
    w = Window.partitionBy(key).orderBy(order)
    same = (F.lag("h").over(w) == F.col("h")) & (F.lag("w").over(w) == F.col("w"))
    f = frames.withColumn("_prev", F.when(same, F.lag("luma").over(w)))
    f = f.withColumn("_m", motion_udf("luma", "_prev", "h", "w"))
    sx, sy = -F.col("_m.dx") / F.col("w"), -F.col("_m.dy") / F.col("h")
    turned = F.pmod(F.col("rotation"), F.lit(360))
    x = F.when(turned == 90, sy).when(turned == 180, -sx).when(turned == 270, -sy).otherwise(sx)
    y = F.when(turned == 90, -sx).when(turned == 180, -sy).when(turned == 270, sx).otherwise(sy)
    none, sure = F.col("_m.sure") < 0, F.col("_m.sure") >= LEAST_MATCH
    shifts = f.withColumns(
        {
            "dx": F.when(none, 0.0).when(sure, x).otherwise(F.col("dyaw") / H_ANGLE),
            "dy": F.when(none, 0.0).when(sure, y).otherwise(-F.col("dpitch") / V_ANGLE),
            "confidence": F.greatest(F.col("_m.sure"), F.lit(0.0)),
        }
    )
    return camera_offset(shifts.drop("_prev", "_m"), key, order)


def wrapped_delta(angle, key: str = "session_id", order: str = "seq") -> Column:
    """Change of an angle since the frame before, within half a turn either way."""
    d = F.col(angle) - F.lag(angle).over(Window.partitionBy(key).orderBy(order))
    return F.coalesce(F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi, F.lit(0.0))


def saturating_fold(flags: Column, goal: int = CAPTURE_AT) -> Column:
    """(count, captured) after a list of flags: up by one, down to no less than zero, captured for good."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("captured"))

    def step(a, x):
        n = F.when(x, a["n"] + 1).otherwise(F.greatest(a["n"] - 1, F.lit(0)))
        return F.struct(n.alias("n"), (a["captured"] | (n >= goal)).alias("captured"))

    return F.aggregate(flags, start, step)


def smoothed(values: Column, alpha: float = SMOOTH_BOX) -> Column:
    """Exponentially smoothed last value of a list."""
    return F.aggregate(F.slice(values, 2, 1 << 30), F.get(values, F.lit(0)).cast("double"), lambda a, x: a * (1 - alpha) + x * alpha)


_TIMED = "session_id IS NOT NULL AND at_ms IS NOT NULL"
FEEDBACK_OUT = "session_id string, label string, at_ms long, candidate long, candidate_ms long"
FEEDBACK_NAMES = [c.split()[0] for c in FEEDBACK_OUT.split(", ")]


class FeedbackBuffer:
    """Recent candidates of one session, the oldest out first."""

    def __init__(self, rows: list | None = None):
        self.rows: list[list] = rows or []

    def prune(self, now: int) -> None:
        self.rows = [r for r in self.rows if now - r[1] <= FEEDBACK_MS]

    def add(self, ident: int, at: int, rank: float) -> None:
        self.prune(at)
        self.rows = [*self.rows, [ident, at, rank]][-FEEDBACK_MOST:]

    def click(self, now: int):
        """The best candidate near the newest, and the buffer emptied; None without any."""
        self.prune(now)
        if not self.rows:
            return None
        newest = self.rows[-1][1]
        best = max((r for r in self.rows if newest - r[1] <= FEEDBACK_RECENT_MS), key=lambda r: r[2])
        self.rows = []
        return best


def _timed(events: DataFrame) -> DataFrame:
    """Rows of a session and a time; absent ids are told by ``unknown``, as pandas would make doubles of all ids beside one."""
    return events.where(_TIMED).withColumns({"unknown": F.col("ident").isNull(), "ident": F.coalesce("ident", F.lit(0))})


def _clicks(buf: FeedbackBuffer, g: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in g.sort_values(["at_ms", "unknown", "ident"], kind="stable").itertuples():
        if r.label is None or r.label != r.label:
            buf.add(None if r.unknown else int(r.ident), int(r.at_ms), float(r.rank))
        elif (best := buf.click(int(r.at_ms))) is not None:
            out.append((r.session_id, r.label, int(r.at_ms), best[0], best[1]))
    return pd.DataFrame(out, columns=FEEDBACK_NAMES, dtype=object)  # whole numbers stay whole beside absent ones


def feedback_batch(events: DataFrame) -> DataFrame:
    """Candidates (no ``label``) and label clicks of sessions, in order of time, to saved candidates;
    rows without a session or a time belong to none."""

    return _timed(events).groupBy("session_id").applyInPandas(lambda g: _clicks(FeedbackBuffer(), g), FEEDBACK_OUT)


def feedback_stream(events: DataFrame, watermark: str = "8 seconds") -> DataFrame:
    """The same over a stream; a session's buffer ends with its event time's watermark.

    Watermarks begin at 1970, and rows from before count as of its first millisecond there, so none is late at the start."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        g = pd.concat(list(parts))
        buf = FeedbackBuffer(json.loads(state.get[0])) if state.exists else FeedbackBuffer()
        out = _clicks(buf, g)
        if len(out):
            yield out
        state.update((json.dumps(buf.rows),))
        state.setTimeoutTimestamp(max(int(g["at_ms"].max()) + FEEDBACK_MS, state.getCurrentWatermarkMs() + 1))

    timed = _timed(events).withColumn("_ts", F.timestamp_millis(F.greatest("at_ms", F.lit(1)))).withWatermark("_ts", watermark)
    return timed.groupBy("session_id").applyInPandasWithState(run, FEEDBACK_OUT, "rows string", "append", GroupStateTimeout.EventTimeTimeout)


def candidate_rank() -> Column:
    return feedback_rank("conf", "productness", "area", "sharpness")


def latest_frames(batch: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Keep-only-latest backpressure: the newest frame of each session in a micro-batch; lossy by intent."""
    last = F.max(order).over(Window.partitionBy(key))
    return batch.withColumn("_last", last).where(F.col(order) == F.col("_last")).drop("_last")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job; streams in update mode."""
    return events.groupBy("job_id").agg(F.max_by("sku_status", "ts").alias("sku_status"), F.max("ts").alias("ts"))


def run_jobs(events: DataFrame, work, sink: str, checkpoint: str):
    """Run ``work(job_id)`` for pending jobs of each batch, on the executors; one
    job's failure is its own state and stops no other.  Results go to a ledger,
    once for each batch, even if the batch is run again: see :func:`job_results`."""

    def done(parts):
        for part in parts:
            rows = []
            for job in part["job_id"]:
                try:
                    rows.append((job, "done", str(work(job)), None))
                except Exception as e:  # a failed job is a result
                    rows.append((job, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["job_id", "sku_status", "sku_report", "note"])

    def run(batch: DataFrame) -> DataFrame:
        pending = batch.where("sku_status = 'pending'").select(F.col("job_id").cast("string").alias("job_id")).distinct()
        return pending.mapInPandas(done, JOB_OUT).withColumn("ts", F.current_timestamp())

    return write_batches(events, sink, checkpoint, run)


def job_results(spark: SparkSession, sink: str) -> DataFrame:
    """What :func:`run_jobs` has committed."""
    return Ledger(spark, sink).read(StructType.fromDDL(f"{JOB_OUT}, ts timestamp"))


def save_feedback(stream: DataFrame, path: str, checkpoint: str):
    """Saved feedback in a ledger, exactly once for each batch; readers find it by ``label``."""
    return write_batches(stream, path, checkpoint)
