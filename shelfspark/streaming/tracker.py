"""The live tracker of one session, its tracks held as columns: a frame costs a
few array operations, however many tracks there are."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Matching, capture, expiry and smoothing of live tracks.
MATCH_IOU, MATCH_LOOK = 0.28, 0.62
CAPTURE_AT, DROP_AFTER, DROP_CAPTURED_AFTER, MOST_TRACKS = 8, 40, 600, 240
SMOOTH_BOX, SMOOTH_LOOK = 0.35, 0.25

BOX = ["x1", "y1", "x2", "y2"]
#: A track; ``look`` is padded with zeros behind its first ``width`` values.
TRACK = [("id", "i8"), ("box", "f8", (4,)), ("width", "i8"), ("good", "i8"), ("missed", "i8"), ("captured", "?"), ("seen", "?"), ("best", "f8")]
ROWS = ["box", "conf", "recognized", "look", "width"]


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boxes in the last axis of two arrays."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.where((w > 0) & (h > 0), w * h, 0.0)
    size = [np.maximum(0.0, x[..., 2] - x[..., 0]) * np.maximum(0.0, x[..., 3] - x[..., 1]) for x in (a, b)]
    return both / (size[0] + size[1] - both + 1e-6)


def widened(look: np.ndarray, width: int) -> np.ndarray:
    return look if look.shape[1] >= width else np.pad(look, ((0, 0), (0, width - look.shape[1])))


def padded(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of one matrix, with their lengths; null is of length 0."""
    width = np.array([len(x) if x is not None else 0 for x in lists], int)
    look = np.zeros((len(lists), max(width, default=0)))
    for row, x, n in zip(look, lists, width):
        row[:n] = x if n else 0
    return look, width


class LiveTracker:
    def __init__(self, next_id: int = 1):
        self.t, self.look, self.next_id = np.zeros(0, TRACK), np.zeros((0, 0)), next_id

    def step(self, box: np.ndarray, conf: np.ndarray, recognized: np.ndarray, look: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """(track of each detection, whether it shows, counters) of one frame."""
        t = self.t
        t["seen"] = False
        t["missed"] += 1
        side = max(self.look.shape[1], look.shape[1])
        self.look, look = widened(self.look, side), widened(look, side)
        owner = self._owners(box, look, width)
        new = np.flatnonzero(owner < 0)
        if len(new):
            owner[new] = len(t) + np.arange(len(new))
            more = np.zeros(len(new), TRACK)
            more["id"], more["box"] = self.next_id + np.arange(len(new)), box[new]
            t = self.t = np.concatenate([t, more])
            self.look = np.concatenate([self.look, np.zeros((len(new), side))])
            self.next_id += len(new)
        self._take(owner, box, conf, recognized, look, width)
        ids, shows = t["id"][owner], ~t["captured"][owner]
        self._prune()
        t = self.t
        counts = {
            "n_visible": int(shows.sum()),
            "n_captured": int(t["captured"].sum()),
            "n_retake": int((t["seen"] & ~t["captured"]).sum()),
            "n_tracked": len(t),
        }
        return ids, shows, counts

    def _owners(self, box, look, width) -> np.ndarray:
        """Row of the track of each detection, -1 without one: pairs by overlap, else by
        look, the best first; of equal pairs the earlier detection, then the earlier track."""
        owner = np.full(len(box), -1)
        if not len(box) or not len(self.t):
            return owner
        over = iou(box[:, None], self.t["box"][None])
        alike = np.where((width[:, None] == self.t["width"][None, :]) & (width[:, None] > 0), look @ self.look.T, 0.0)
        near = over >= MATCH_IOU
        i, j = np.nonzero(near | (alike >= MATCH_LOOK))
        score = np.where(near, 1 + over, alike)[i, j]
        free = np.ones(len(self.t), bool)
        for p in np.argsort(-score, kind="stable"):
            if owner[i[p]] < 0 and free[j[p]]:
                owner[i[p]], free[j[p]] = j[p], False
        return owner

    def _take(self, owner, box, conf, recognized, look, width) -> None:
        t = self.t
        old = t["box"][owner]
        near = iou(old, box) >= MATCH_IOU
        t["box"][owner] = np.where(near[:, None], old * (1 - SMOOTH_BOX) + box * SMOOTH_BOX, box)
        t["seen"][owner], t["missed"][owner] = True, 0
        t["best"][owner] = np.fmax(t["best"][owner], conf)
        for at, new, n in zip(owner, look, width):
            if n and not t["captured"][at]:
                self._blend(at, new, n)
        good = t["good"][owner]
        t["good"][owner] = np.where(recognized, good + 1, np.maximum(0, good - 1))
        t["captured"][owner] |= t["good"][owner] >= CAPTURE_AT

    def _blend(self, at: int, new: np.ndarray, n: int) -> None:
        """A look mixed with a new one, of unit length; a first one as it is."""
        had = self.t["width"][at]
        if had:
            n = min(had, n)
            new = np.where(np.arange(len(new)) < n, self.look[at] * (1 - SMOOTH_LOOK) + new * SMOOTH_LOOK, 0.0)
            size = np.sqrt((new * new).sum())
            new = new / size if size > 1e-6 else new
        self.look[at], self.t["width"][at] = new, n

    def _prune(self) -> None:
        t = self.t
        keep = t["missed"] <= np.where(t["captured"], DROP_CAPTURED_AFTER, DROP_AFTER)
        if (extra := int(keep.sum()) - MOST_TRACKS) > 0:
            longest = np.argsort(-t["missed"], kind="stable")
            keep[longest[keep[longest] & ~t["captured"][longest]][:extra]] = False
        if not keep.all():
            self.t, self.look = t[keep], self.look[keep]

    @property
    def tracks(self) -> list[np.record]:
        return list(self.t.view(np.recarray))

    def frame(self, dets: list[dict]) -> tuple[list[tuple[int, bool]], dict]:
        """:meth:`step` of detections as dictionaries: ``box``, ``conf``, ``recognized``, ``signature``."""
        look, width = padded([d["signature"] for d in dets])
        box = np.array([d["box"] for d in dets], float).reshape(-1, 4)
        ids, shows, counts = self.step(box, np.array([d["conf"] for d in dets], float), np.array([d["recognized"] for d in dets], bool), look, width)
        return list(zip(ids.tolist(), shows.tolist())), counts

    def dump(self) -> str:
        rows = [dict(zip(self.t.dtype.names, (v.tolist() for v in r))) for r in self.t]
        return json.dumps({"next": self.next_id, "tracks": [{**r, "look": look[: r["width"]].tolist()} for r, look in zip(rows, self.look)]})

    @classmethod
    def load(cls, text: str) -> LiveTracker:
        data = json.loads(text)
        out = cls(data["next"])
        out.look, width = padded([r["look"] for r in data["tracks"]])
        out.t = np.zeros(len(width), TRACK)
        for name in out.t.dtype.names:
            out.t[name] = width if name == "width" else np.array([r[name] for r in data["tracks"]]).reshape(out.t[name].shape)
        return out


def whole_frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted detections cut between frames; a frame that a batch cuts waits for its rest."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            part = pa.concat_tables([rest, part])
        if not part.num_rows:
            continue
        cut = int(starts(part)[-1])
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def starts(t: pa.Table) -> np.ndarray:
    """First row of each frame."""
    new = np.ones(t.num_rows, bool)
    session, seq = (np.array(t.column(c).to_pylist(), object) for c in ("session_id", "seq"))
    new[1:] = (session[1:] != session[:-1]) | (seq[1:] != seq[:-1])
    return np.flatnonzero(new)


def replay(t: pa.Table, tracker: LiveTracker, session: str | None) -> Iterator[tuple[tuple, LiveTracker]]:
    """Counters of each frame of a sorted table, with the tracker that saw it: the given
    one goes on with ``session``, every other session gets one of its own."""
    at = [*starts(t).tolist(), t.num_rows]
    sessions, seqs = t.column("session_id").to_pylist(), t.column("seq").to_pylist()
    real = t.column("ord").fill_null(-1).to_numpy() >= 0
    look, width = padded(t.column("signature").to_pylist())
    number = {c: t.column(c).cast(pa.float64()).to_numpy() for c in [*BOX, "conf"]}
    rows = {
        "box": np.column_stack([number[c] for c in BOX]),
        "conf": number["conf"],
        "recognized": t.column("recognized").cast(pa.bool_()).fill_null(False).to_numpy(),
        "look": look,
        "width": width,
    }
    for a, b in zip(at[:-1], at[1:]):
        if sessions[a] != session:
            tracker, session = LiveTracker(), sessions[a]
        on = a + np.flatnonzero(real[a:b])
        counts = tracker.step(*(rows[c][on] for c in ROWS))[2]
        yield (session, seqs[a], len(on), *counts.values()), tracker
