"""Crowded images: the grid keeps what the matrix of all pairs keeps."""

import tracemalloc

import numpy as np
import pytest

from shelfspark.operators import boxgrid


def boxes(n, seed, large=0.02, copies=0.2):
    rng = np.random.default_rng(seed)
    at, size = rng.uniform(0, 1000, (n, 2)), rng.uniform(1, 30, (n, 2))
    wide = rng.random(n) < large
    size[wide] = rng.uniform(100, 900, (int(wide.sum()), 2))
    b = np.concatenate([at, at + size], axis=1)
    again = rng.random(n) < copies
    b[again] = b[rng.integers(0, n, int(again.sum()))] + rng.integers(-1, 2, (int(again.sum()), 4))
    return b


def plain_pick(box, bad, first=0):
    kept = []
    for i in range(len(box)):
        if i < first or not (kept and bad(box[kept], box[i][None]).any()):
            kept.append(i)
    return kept


RULES = {
    "reaches": lambda a, b: boxgrid.iou(a, b, 0.0) >= 0.5,
    "exceeds": lambda a, b: boxgrid.iou(a, b, 1e-6) > 0.3,
    "contains": lambda a, b: (boxgrid.overlap(a, b)[0] / (boxgrid.overlap(a, b)[2] + 1e-6) > 0.8) & (boxgrid.overlap(a, b)[0] > 0),
}


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("first", [0, 30])
def test_grid_keeps_what_all_pairs_keep(monkeypatch, rule, first):
    box = boxes(900, 4)
    box[5], box[6], box[7] = [3, 3, 3, 3], [50, 50, 20, 20], [np.nan, 0, 10, 10]
    box[8] = [-np.inf, 0, np.inf, 5]
    with np.errstate(invalid="ignore"):
        want = plain_pick(box, RULES[rule], first)
        for block, pairs in ((64, 100), (64, 1 << 20), (5000, 1 << 20)):
            monkeypatch.setattr(boxgrid, "BLOCK", block)
            monkeypatch.setattr(boxgrid, "PAIRS", pairs)
            assert boxgrid.pick(box, RULES[rule], first) == want
    assert boxgrid.pick(box[:0], RULES[rule]) == []


def test_matches_by_grid_equal_those_of_all_pairs(monkeypatch):
    a, b = boxes(400, 1), boxes(500, 2)
    b[:300] = a[:300] + np.random.default_rng(3).uniform(-2, 2, (300, 4))
    b[300:320] = a[0]  # ties
    for least in (0.3, 0.5):
        want = boxgrid.matched(a, b, least, 1e-6)
        with monkeypatch.context() as m:
            m.setattr(boxgrid, "PAIRS", 1000)
            assert boxgrid.matched(a, b, least, 1e-6) == want > 100
    assert boxgrid.matched(a[:0], b, 0.5, 0.0) == 0


def test_fifty_thousand_boxes_of_one_image():
    rng = np.random.default_rng(9)
    at = rng.uniform(0, 4000, (50_000, 2))
    box = np.concatenate([at, at + rng.uniform(5, 40, (50_000, 2))], axis=1)
    box[:5000] = box[0]  # a pile
    tracemalloc.start()
    kept = boxgrid.pick(box, RULES["reaches"])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 300 << 20 and 1 <= sum(i < 5000 for i in kept) < 2 and len(kept) > 20_000
    sample = rng.choice(50_000, 300, replace=False)
    mine = set(kept)
    held = np.array(kept)
    for i in sample:  # kept if and only if no kept one before it overlaps so much
        before = held[held < i]
        assert (not RULES["reaches"](box[before], box[i][None]).any()) == (i in mine)
