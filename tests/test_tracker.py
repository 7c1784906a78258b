"""The live tracker against a plain one that looks at every pair in turn."""

import random

import pytest

from shelfspark.streaming import live, tracker
from shelfspark.streaming.tracker import LiveTracker


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = sum(max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b))
    return w * h / (size - w * h + 1e-6)


class Plain:
    def __init__(self):
        self.tracks, self.n = [], 0

    def frame(self, dets):
        for t in self.tracks:
            t["seen"], t["missed"] = False, t["missed"] + 1
        pairs = []
        for i, d in enumerate(dets):
            for j, t in enumerate(self.tracks):
                s, u = d["signature"] or [], t["look"]
                alike = sum(x * y for x, y in zip(s, u)) if s and len(s) == len(u) else 0.0
                if overlap(d["box"], t["box"]) >= 0.28:
                    pairs.append((-1 - overlap(d["box"], t["box"]), i, j))
                elif alike >= 0.62:
                    pairs.append((-alike, i, j))
        mine, used = {}, set()
        for _, i, j in sorted(pairs):
            if i not in mine and j not in used:
                mine[i] = self.tracks[j]
                used.add(j)
        for i, d in enumerate(dets):
            if i not in mine:
                self.n += 1
                mine[i] = {"id": self.n, "box": d["box"], "look": [], "good": 0, "missed": 0, "captured": False}
                self.tracks.append(mine[i])
            t = mine[i]
            if overlap(t["box"], d["box"]) >= 0.28:
                t["box"] = [p * 0.65 + q * 0.35 for p, q in zip(t["box"], d["box"])]
            else:
                t["box"] = d["box"]
            t["seen"], t["missed"] = True, 0
            if d["signature"] and not t["captured"]:
                mixed = [p * 0.75 + q * 0.25 for p, q in zip(t["look"], d["signature"])] if t["look"] else d["signature"]
                size = sum(x * x for x in mixed) ** 0.5
                t["look"] = [x / size for x in mixed] if t["look"] and size > 1e-6 else mixed
            t["good"] = t["good"] + 1 if d["recognized"] else max(0, t["good"] - 1)
            t["captured"] = t["captured"] or t["good"] >= 8
        out = [(mine[i]["id"], not mine[i]["captured"]) for i in range(len(dets))]
        self.tracks = [t for t in self.tracks if t["missed"] <= (600 if t["captured"] else 40)]
        for t in sorted(self.tracks, key=lambda t: -t["missed"]):
            if len(self.tracks) > 240 and not t["captured"]:
                self.tracks = [x for x in self.tracks if x is not t]
        counts = {
            "n_visible": sum(v for _, v in out),
            "n_captured": sum(t["captured"] for t in self.tracks),
            "n_retake": sum(t["seen"] and not t["captured"] for t in self.tracks),
            "n_tracked": len(self.tracks),
        }
        return out, counts


def some_frames(seed, n, most, widths=(0, 4, 4, 6)):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        dets = []
        for _ in range(r.randrange(most + 1)):
            x, y, side = r.randrange(20) / 20, r.randrange(20) / 20, r.choice([0.0, 0.1, 0.2])
            width = r.choice(widths)
            look = [0.0] * width
            for _ in range(2 if width else 0):
                look[r.randrange(width)] = 0.75
            dets.append({"box": [x, y, x + side, y + side], "conf": r.random(), "recognized": r.random() < 0.8, "signature": look if r.random() < 0.9 else None})
        out.append(dets)
    return out


@pytest.mark.parametrize("seed, n, most", [(1, 300, 3), (2, 60, 60), (3, 700, 1), (4, 40, 0)])
def test_equal_to_a_plain_tracker(seed, n, most):
    plain, t = Plain(), LiveTracker()
    for at, dets in enumerate(some_frames(seed, n, most)):
        assert t.frame(dets) == plain.frame(dets), at
        if at % 17 == 0:
            t = LiveTracker.load(t.dump())  # the state goes through its text
    assert len(t.tracks) <= tracker.MOST_TRACKS + sum(x.captured for x in t.tracks)


def test_more_tracks_than_are_kept():
    """Captured tracks stay, of the others those seen last."""
    plain, t = Plain(), LiveTracker()
    row = [{"box": [float(i), 0.0, i + 0.5, 1.0], "conf": 0.5, "recognized": i < 30, "signature": None} for i in range(400)]
    for dets in [row[:30]] * 8 + [row[a : a + 100] for a in range(30, 330, 100)] + [row]:
        assert t.frame(dets) == plain.frame(dets)
    assert len(t.tracks) == tracker.MOST_TRACKS and sum(x.captured for x in t.tracks) == 30


ROWS = "session_id string, seq long, ord int, x1 double, y1 double, x2 double, y2 double, conf double, recognized boolean, signature array<double>, SEQ_note string"


def as_rows(session, frames):
    for seq, dets in enumerate(frames):
        if not dets:
            yield (session, seq, -1, *[None] * 5, None, None, "none")
        for i, d in enumerate(dets):
            yield (session, seq, i, *d["box"], d["conf"], d["recognized"], d["signature"], "x")


@pytest.mark.parametrize("parts", [1, 7])
def test_batches_cut_frames_and_sessions(spark, parts):
    """A null session is one of them; batches of five rows cut frames; rows without a frame are left out."""
    runs = {s: some_frames(len(s or ""), 40, 6) for s in ("a", "bb", "ccc", None)}
    rows = [r for s, f in runs.items() for r in as_rows(s, f)] + [("a", None, 0, *[0.5] * 5, True, None, "no frame")]
    df = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), ROWS).repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(r["session_id"], r["seq"]): r.asDict() for r in live.track_batch(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 160
    for s, frames in runs.items():
        plain = Plain()
        for seq, dets in enumerate(frames):
            want = {"session_id": s, "seq": seq, "n_detections": len(dets), **plain.frame(dets)[1]}
            assert got[s, seq] == want


def test_no_detections(spark):
    empty = live.track_batch(spark.createDataFrame([], ROWS))
    assert empty.collect() == [] and empty.columns == live.FRAME_NAMES
