"""Order-dependent box and frame operators.

Groups (an image, a video) are small and independent.  They are dealt out by
their keys, sorted, and worked off in order, many in one batch: a group costs a
few array operations, not a call from the JVM.

Ties: the score descending, then ``ord`` ascending, everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boxgrid

BOX = ["x1", "y1", "x2", "y2"]


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new group begins in sorted rows; nulls are one group."""
    new = np.zeros(len(pdf), dtype=bool)
    if len(pdf):
        new[0] = True
    for k in keys:
        code, _ = pd.factorize(pdf[k], use_na_sentinel=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def in_groups(df: DataFrame, keys: list[str], order: list[Column], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema) -> DataFrame:
    """``work(rows, starts)`` on whole groups, several at a time, each in order."""

    def run(it):
        open_: list[pd.DataFrame] = []  # parts of the group that may go on, put together once
        for pdf in it:
            if not len(pdf):
                continue
            at = _starts(pdf, keys)
            if open_ and len(_starts(pd.concat([open_[-1].iloc[-1:], pdf.iloc[:1]], ignore_index=True), keys)) > 1:
                yield work(pd.concat(open_, ignore_index=True), np.zeros(1, dtype=int))
                open_ = []
            if len(at) == 1:
                open_.append(pdf)
                continue
            head = pd.concat([*open_, pdf.iloc[: at[-1]]], ignore_index=True)
            yield work(head, _starts(head, keys))
            open_ = [pdf.iloc[at[-1] :]]
        if open_:
            yield work(pd.concat(open_, ignore_index=True), np.zeros(1, dtype=int))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def kept_rows(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], choose) -> DataFrame:
    """The rows that ``choose`` picks of each group: it gets one array for each of
    ``columns`` and returns positions."""

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        arrays = [pdf[c].to_numpy() for c in columns]
        out = []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            out.append(a + np.asarray(choose(*[x[a:b] for x in arrays]), dtype=int))
        return pdf.iloc[np.concatenate(out)] if out else pdf

    return in_groups(df, keys, order, work, df.schema)


def nms(boxes: DataFrame, keys: list[str], threshold: float, keep_equal: bool = False, eps: float = 0.0, score: str = "score") -> DataFrame:
    """Boxes kept by descending score: one goes if its overlap with a kept one
    reaches the threshold (above 0; with ``keep_equal``: exceeds it)."""

    def bad(a, b):
        m = boxgrid.iou(a, b, eps)
        return m > threshold if keep_equal else m >= threshold

    def choose(*xy):
        return boxgrid.pick(np.stack(xy, axis=1).astype(float), bad)

    return kept_rows(boxes, keys, [F.desc(score), F.asc("ord")], BOX, choose)


def contain_suppress(boxes: DataFrame, keys: list[str], contain: float = 0.8, overlap: float = 0.7) -> DataFrame:
    """Largest first; a box goes if more than ``contain`` of it lies in a kept one or they overlap by more than ``overlap``."""

    def bad(a, b):
        both, size, later = boxgrid.overlap(a, b)
        return ((both / (later + 1e-6) > contain) | (both / (size + later - both + 1e-6) > overlap)) & (both > 0)

    def choose(*xy):
        return boxgrid.pick(np.stack(xy, axis=1).astype(float), bad)

    largest = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return kept_rows(boxes, keys, [largest.desc(), F.asc("ord")], BOX, choose)


def match_counts(boxes: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Per image the number of true (``is_truth``) and predicted boxes and of matches."""
    names = [key, "gt", "pred", "tp", "fp", "fn"]

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        box, truth, out = pdf[BOX].to_numpy(float), pdf["is_truth"].to_numpy(bool), []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            t = truth[a:b]
            gt, pred = box[a:b][t], box[a:b][~t]
            tp = boxgrid.matched(pred, gt, threshold, 1e-6) if len(gt) and len(pred) else 0
            out.append((pdf[key].iat[a], len(gt), len(pred), tp, len(pred) - tp, len(gt) - tp))
        return pd.DataFrame(out, columns=names)

    kind = boxes.schema[key].dataType.simpleString()
    return in_groups(boxes, [key], [F.asc("ord")], work, f"{key} {kind}, gt long, pred long, tp long, fp long, fn long")


def override_merge(rows: DataFrame, key: str, same: float = 0.65, other: float = 0.35) -> DataFrame:
    """Labels with manual entries (``manual``) merged in: an entry like a label of
    its class is skipped, labels of another class under it go."""

    def choose(x1, y1, x2, y2, cls, manual):
        box = np.stack([x1, y1, x2, y2], axis=1).astype(float)
        over = boxgrid.iou(box[:, None], box[None, :], 0.0)
        have = [i for i in range(len(box)) if not manual[i]]
        for m in np.flatnonzero(manual.astype(bool)):
            if any(cls[i] == cls[m] and over[i, m] > same for i in have):
                continue
            have = [i for i in have if cls[i] == cls[m] or over[i, m] <= other] + [int(m)]
        return sorted(have, key=lambda i: (y1[i], x1[i], i))

    return kept_rows(rows, [key], [F.asc("ord")], [*BOX, "cls", "manual"], choose)


def text_anchors(rows: DataFrame, key: str, overlap: float = 0.35) -> DataFrame:
    """Anchors (``anchor``) in order, without those over an existing label or an earlier anchor."""

    def choose(x1, y1, x2, y2, anchor):
        box, anchor = np.stack([x1, y1, x2, y2], axis=1).astype(float), anchor.astype(bool)
        order = np.concatenate([np.flatnonzero(~anchor), np.flatnonzero(anchor)])
        labels = len(box) - int(anchor.sum())
        return [int(order[i]) for i in boxgrid.pick(box[order], lambda a, b: boxgrid.iou(a, b, 0.0) > overlap, labels) if i >= labels]

    return kept_rows(rows, [key], [F.asc("ord")], [*BOX, "anchor"], choose)


def keep_if_changed(frames: DataFrame, key: str, values: str, least: float) -> DataFrame:
    """Frames whose mean absolute difference from the last *kept* one is ``least`` or more; the first stays."""

    def choose(v):
        kept, last = [], None
        for i, x in enumerate(v):
            x = np.asarray(x, float)
            if last is None or np.abs(x - last).mean() >= least:
                kept.append(i)
                last = x
        return kept

    return kept_rows(frames, [key], [F.asc("ord")], [values], choose)
