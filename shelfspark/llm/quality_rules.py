"""Operator 8: quality rules by hashed n-gram logistic regression.

Word runs of one and two and byte runs of three and four are hashed into one
weight table; a text's margin is the mean weight of its n-grams.  The weights
are fitted on labelled quality rows, the margin is calibrated to a probability
on folds that did not see the row, and Arrow batches are scored against fixed
thresholds beside counted rules (words, repetition).

The fit takes at most ``SAMPLE`` labelled rows, a documented bound; held-out
documents (see :mod:`labelled`) are never among them.  Three tasks fit at once: on
all of them, and without each of two folds for the calibration.
Defined results: null is no text (0 words, so it fails the base rules); repeated
rows each get a row; without labels of both classes only the base rules decide;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byteblock import BLOCK, SYMBOLS, Block
from .common import blocks, by_place, cut, give_back, id_text, place, text_blocks
from .labelled import sample

SAMPLE = 2000
BITS = 15
SCALE = 64.0
STEPS = 80
KEEP_FROM = 0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Fixed odd multipliers of the byte hash.
ODD = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]


def gram_slots(b: Block):
    """For each kind of n-gram: slots of all of them, and each text's range in them."""
    mask = np.uint64((1 << BITS) - 1)
    for n in (1, 2):
        h, first = b.grams(n)
        lo = np.searchsorted(first, b.word_at[:-1])
        hi = np.searchsorted(first, b.word_at[1:])
        yield (mix_kind(h, n) & mask).astype(np.int32), lo, hi
    d = b.data.astype(np.uint32)
    for n in (3, 4):
        if len(d) < n:
            continue
        h = np.zeros(len(d) - n + 1, np.uint32)
        for k in range(n):
            h = (h ^ d[k : len(d) - n + 1 + k]) * np.uint32(ODD[k])
            h ^= h >> np.uint32(15)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), b.starts, np.maximum(b.ends - n + 1, b.starts)


def mix_kind(h: np.ndarray, n: int) -> np.ndarray:
    return (h * np.uint64(2 * n + 1)) >> np.uint64(32)


def margins(b: Block, weights: np.ndarray) -> np.ndarray:
    total, count = np.zeros(b.n), np.zeros(b.n)
    for slots, lo, hi in gram_slots(b):
        c = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
        hi = np.minimum(hi, len(slots))
        lo = np.minimum(lo, hi)
        total += c[hi] - c[lo]
        count += hi - lo
    return SCALE * total / np.maximum(count, 1)


def sparse(b: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, share of the text's n-grams) of each text."""
    kinds = list(gram_slots(b))
    out = []
    for i in range(b.n):
        s = [slots[lo[i] : max(hi[i], lo[i])] for slots, lo, hi in kinds]
        both = np.concatenate(s) if s else np.zeros(0, np.int32)
        u, c = np.unique(both, return_counts=True)
        out.append((u.astype(np.int32), (c / max(len(both), 1)).astype(np.float32)))
    return out


@dataclass
class RulesModel:
    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, b: Block) -> np.ndarray:
        if self.weights is None:
            return np.ones(b.n)
        z = self.slope * (margins(b, self.weights) + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: Shares that one step of the descent works on at once.
DESCENT_BLOCK = 1 << 19


def _descend(cols: list[np.ndarray], vals: list[np.ndarray], y: np.ndarray, steps: int, l2: float = 1e-4):
    """Logistic regression by full-batch Adam on sparse rows (none empty), whose
    gradients are summed block by block."""
    rows = []
    for a, e in blocks(list(map(len, cols)), DESCENT_BLOCK):
        sizes = np.fromiter(map(len, cols[a:e]), dtype=np.int64, count=e - a)
        rows.append((np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, np.concatenate(cols[a:e]), np.concatenate(vals[a:e]), y[a:e]))
    w, b, n = np.zeros(1 << BITS), 0.0, len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        gw, gb, w32 = l2 * w, 0.0, w.astype(np.float32)
        for at, sizes, col, val, label in rows:
            part = w32[col]
            part *= val
            z = SCALE * np.add.reduceat(part, at) + b
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) / n
            part = np.repeat(g.astype(np.float32), sizes)
            part *= val
            gw += SCALE * np.bincount(col, part, minlength=len(w))
            gb += g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, with the usual smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -50, 50)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(c)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col="doc_id", text_col="text", label_col="quality") -> RulesModel:
    def features(it):
        for batch in it:
            got = [f for _, texts in text_blocks(batch, BLOCK) for f in sparse(Block(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_label"),
                    batch.column("_fold"),
                    pa.array([u.tobytes() for u, _ in got], pa.binary()),
                    pa.array([c.tobytes() for _, c in got], pa.binary()),
                    batch.column("_order"),
                ],
                ["label", "fold", "slots", "shares", "ord"],
            )

    rows = sample(docs, labels, most, "rules", id_col, text_col, label_col).withColumn("_order", F.xxhash64(F.col("_id").cast("string")))
    # ``most`` rows of at most 2**BITS slots each; texts without any say nothing
    found = rows.mapInArrow(features, "label double, fold int, slots binary, shares binary, ord long").where("octet_length(slots) > 0")
    rows = cut(found)
    seen = rows.agg(F.countDistinct("label"), *[F.countDistinct(F.when(F.col("fold") % 2 == k, F.col("label"))) for k in (0, 1)]).first()
    if seen[0] < 2:
        return RulesModel(None)
    both = seen[1] == 2 and seen[2] == 2

    def train(t: pa.Table) -> pa.Table:
        """The fit without fold ``part`` (2: with all rows), and the margins of that fold's rows."""
        order = np.argsort(t.column("ord").to_numpy(), kind="stable")
        part = t.column("part")[0].as_py()
        cols = [np.frombuffer(t.column("slots")[int(k)].as_buffer(), np.int32) for k in order]
        vals = [np.frombuffer(t.column("shares")[int(k)].as_buffer(), np.float32) for k in order]
        t = t.select(["label", "fold"]).take(pa.array(order))
        y, out = np.array(t.column("label").to_pylist()), np.array(t.column("fold").to_pylist()) % 2 == part
        i = np.flatnonzero(~out if both else np.ones(len(y), bool))
        w, b = _descend([cols[k] for k in i], [vals[k] for k in i], y[i], STEPS)
        z = [SCALE * float(vals[k] @ w[cols[k]]) + b for k in np.flatnonzero(out)]
        del cols, vals
        give_back()
        return pa.table(
            {
                "part": pa.array([part], pa.int32()),
                "weights": pa.array([w.astype(np.float32).tobytes() if part == 2 else b""], pa.binary()),
                "bias": pa.array([float(b)], pa.float64()),
                "z": pa.array([z], pa.list_(pa.float64())),
                "y": pa.array([y[out].tolist()], pa.list_(pa.float64())),
            }
        )

    # three tasks of ``most`` rows each: all rows, and without either half
    parts = rows.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).repartition(3, "part").groupBy("part").applyInArrow(
        train, "part int, weights binary, bias double, z array<double>, y array<double>"
    )
    got = {r["part"]: r for r in parts.collect()}  # three rows, ``most`` numbers in two of them
    w, b = np.frombuffer(got[2]["weights"], np.float32), got[2]["bias"]
    held = [got[k] for k in (0, 1) if k in got]
    z, y = np.array([x for r in held for x in r["z"]]), np.array([x for r in held for x in r["y"]])
    return RulesModel(w, b, *_platt(z, y))


def counts(b: Block) -> dict[str, np.ndarray]:
    """The counted rules' inputs, exact."""
    char = b.code_points()
    return {
        "n_words": b.n_words,
        "word_chars": b.per_text(char & ~b.space),
        "n_symbols": b.per_text(SYMBOLS[b.data]),
        "n_dup_lines": b.duplicate_lines(),
        "n_repeat_words": b.repeated_words(),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]


def verdicts(texts: list[str], model: RulesModel) -> dict[str, np.ndarray]:
    """All of ``NAMES`` for the texts of one block."""
    b = Block(texts)
    c = counts(b)
    c["base_failed"] = base_failed(c)
    c["probability"] = model.probability(b)
    c["kept"] = ~c["base_failed"] & (c["probability"] >= KEEP_FROM)
    return c


def apply_rules(docs: DataFrame, model: RulesModel, id_col="doc_id", text_col="text") -> DataFrame:
    """``id_col``, the five counts, ``base_failed``, ``probability``, ``kept``."""
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "probability": pa.float64()}

    def run(it):
        for batch in it:
            for a, texts in text_blocks(batch, BLOCK):
                v = verdicts(texts, model)
                cols = [pa.array(v[k].astype(bool) if kinds.get(k) == pa.bool_() else v[k], kinds.get(k, pa.int64())) for k in NAMES]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, len(texts)), *cols], ["_id", *NAMES])

    schema = f"_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def filter_rules(docs: DataFrame, model: RulesModel, text_col="text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    rows, text = by_place(docs), place(docs, text_col)

    def run(it):
        for batch in it:
            for a, texts in text_blocks(batch, BLOCK, text):
                yield batch.slice(a, len(texts)).filter(pa.array(verdicts(texts, model)["kept"].astype(bool)))
        give_back()

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
