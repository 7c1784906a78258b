"""Operator 3: quality scores from random Fourier features.

Statistics of a text (shares of character kinds, repetition, word and line
shape, none of them a label, source, language or id) are mapped to cosine
features whose inner products approximate a Gaussian kernel.  Each task sums its
part of the normal equations; the sums give ridge weights, and isotonic
regression on rows that the ridge fit did not see turns its output into a score.

The model is fitted on at most ``SAMPLE`` labelled rows, a documented bound.
Defined results: null and empty texts are scored like any other (all statistics
0); repeated rows each get a row; with no labelled rows, or one class only,
every score is that class's share (0.5 without any); an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byteblock import BLOCK, SYMBOLS, Block, lut
from .common import by_place, cut, give_back, id_text, place, text_blocks
from .labelled import held_out, sample

SAMPLE = 8000
FEATURES = 192
WIDTH = 1.5
RIDGE = 1e-3
SEED = 20240501

KINDS = [
    lut(bytes(range(97, 123))),
    lut(bytes(range(65, 91))),
    lut(bytes(range(48, 58))),
    SYMBOLS,
    lut(b".,;:?"),
    lut(b"!"),
    lut(b"-_/\\=+~^@\"'()[]{}"),
    lut(b"\n"),
]


def statistics(b: Block) -> np.ndarray:
    """One row of statistics for each text, each of about unit size."""
    size = np.maximum(b.sizes, 1)
    words = np.maximum(b.n_words, 1)
    cols = [b.per_text(k[b.data]) / size for k in KINDS]
    cols[7] = np.minimum(cols[7] * 20, 3)  # a line feed is rarer than a letter
    w_start, w_end = b.words
    length = np.minimum(w_end - w_start, 64)
    head = b.word_at[:-1]

    def by_text(v):
        c = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
        return c[b.word_at[1:]] - c[head]

    mean = by_text(length) / words
    cols += [mean / 8, np.sqrt(np.maximum(by_text(length.astype(float) ** 2) / words - mean**2, 0)) / 6]
    order, same = b.repeats(b.word_hash, b.word_text)
    again = np.zeros(len(same))
    again[order[same]] = 1
    cols.append(by_text(again) / words)  # words seen before in the text
    twin = np.zeros(len(b.word_hash))
    if len(twin) > 1:
        twin[1:] = (b.word_hash[1:] == b.word_hash[:-1]) & (b.word_text[1:] == b.word_text[:-1])
    cols.append(by_text(twin) / words * 2)
    cols.append(b.repeated_words() / words * 2)
    symbol = np.concatenate([[0], np.cumsum(SYMBOLS[b.data])])
    cols.append(by_text(symbol[w_end] > symbol[w_start]) / words * 2)
    first = b.data[w_start] if len(w_start) else np.zeros(0, np.uint8)
    cols.append(by_text((first >= 65) & (first <= 90)) / words)
    lines = np.maximum(np.bincount(b.lines[2], minlength=b.n), 1)
    cols.append(b.duplicate_lines() / lines)
    cols.append(np.log1p(b.n_words) / 8)
    return np.stack(cols, axis=1)


N_STATS = 17


def fourier(seed: int = SEED, features: int = FEATURES, width: float = WIDTH):
    rng = np.random.default_rng(seed)
    return rng.normal(0, width, (N_STATS, features)), rng.uniform(0, 2 * np.pi, features)


def lift(x: np.ndarray, basis) -> np.ndarray:
    w, phase = basis
    z = np.cos(x @ w + phase) * np.sqrt(2 / w.shape[1])
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean scores and labels of the pools of the best monotone step curve; equal
    scores are one point."""
    points, at = np.unique(score, return_inverse=True)
    number = np.bincount(at)
    pools: list[list[float]] = []
    for s, y, n in zip((points * number).tolist(), np.bincount(at, label).tolist(), number.tolist()):
        pools.append([y, n, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, s2 = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][2] += s2
    a = np.array(pools)
    return a[:, 2] / a[:, 1], a[:, 0] / a[:, 1]


@dataclass
class QualityModel:
    weights: np.ndarray | None
    xs: np.ndarray
    ys: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lift(x, fourier()) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.ys[0])
        return np.clip(np.interp(self.raw(x), self.xs, self.ys), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col="doc_id", text_col="text", label_col="quality") -> QualityModel:
    def stats(it):
        for batch in it:
            x = _stats_of(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("_label"), batch.column("_fold")],
                ["x", "label", "fold"],
            )

    rows = cut(sample(docs, labels, most, "rff", id_col, text_col, label_col).mapInArrow(stats, "x array<double>, label double, fold int"))

    def normal(it):
        basis = fourier()
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        seen = 0
        for batch in it:
            fold = np.array(batch.column("fold").to_pylist())
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(len(fold), -1)[fold != 0]
            y = np.array(batch.column("label").to_pylist(), dtype=float)[fold != 0]
            if len(y):
                z = lift(x, basis)
                total += np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)
                seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())],
                ["slot", "sums", "n"],
            )

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=float) for x in t.column("sums").to_pylist())
        n = sum(t.column("n").to_pylist())
        return pa.table({"slot": t.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    sums = "slot int, sums binary, n long"
    parts = rows.mapInArrow(normal, sums).groupBy("slot").applyInArrow(add, sums).collect()  # 8 rows at most
    share = rows.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if share[1] is None or share[1] == share[2] or not parts:
        return QualityModel(None, np.zeros(1), np.array([0.5 if share[0] is None else share[0]]))
    size = FEATURES + 1
    total = sum(np.frombuffer(p["sums"], dtype=float) for p in parts).reshape(size, size + 1)
    n = sum(p["n"] for p in parts)
    penalty = np.full(size, RIDGE * n)
    penalty[-1] = 0
    model = QualityModel(np.linalg.solve(total[:, :size] + np.diag(penalty) + 1e-9 * np.eye(size), total[:, size]), np.zeros(1), np.zeros(1))
    held = rows.where("fold = 0").select("x", "label").collect()  # a quarter of the bounded sample
    if len({r["label"] for r in held}) < 2:
        held = rows.select("x", "label").collect()
    x, y = np.array([r["x"] for r in held]), np.array([r["label"] for r in held])
    model.xs, model.ys = isotonic(model.raw(x), y)
    return model


def _stats_of(batch: pa.RecordBatch, name: str = "_text") -> np.ndarray:
    done = [statistics(Block(texts)) for _, texts in text_blocks(batch, BLOCK, name)]
    return np.concatenate(done) if done else np.zeros((0, N_STATS))


def score_quality(docs: DataFrame, model: QualityModel, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        for batch in it:
            s = model.score(_stats_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                ["_id", "score", "predicted"],
            )

    out = id_text(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, score double, predicted int")
    return out.withColumnRenamed("_id", id_col)


def filter_quality(docs: DataFrame, model: QualityModel, text_col="text") -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns as they were."""
    rows, text = by_place(docs), place(docs, text_col)

    def run(it):
        for batch in it:
            for a, texts in text_blocks(batch, BLOCK, text):
                good = model.score(statistics(Block(texts))) >= 0.5
                yield batch.slice(a, len(texts)).filter(pa.array(good))
        give_back()

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


__all__ = ["QualityModel", "fit", "score_quality", "filter_quality", "held_out"]
