"""Crops, object recognition, motion and pixel measures against plain versions."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from shelfspark.functions import geometry, pixels, text, web
from shelfspark.operators import datasets, objects
from shelfspark.sources import readers, reports
from shelfspark.streaming import live


def plain_score(r):
    return objects.STATUS_RANK.get(r["status"], 0) * 10 + r["confidence"] + len(r["text"]) * 1e-4


def plain_recognition(crops, enhanced, visual, retry):
    """The rule read by read; ``None``: no such read."""
    best, votes, used = None, {}, 0
    for i, r in enumerate(crops):
        used += 1
        if best is None or plain_score(r) > plain_score(best):
            best = r
        if r["status"] == "matched_sku" and r["sku_id"]:
            v = votes.setdefault(r["sku_id"], [0, r])
            v[0] += 1
            if plain_score(r) > plain_score(v[1]):
                v[1] = r
        if r["status"] == "matched_sku" and (r["confidence"] >= 0.86 or i == 0):
            break
    if retry and not votes and enhanced:
        if plain_score(enhanced) > plain_score(best):
            best = enhanced
        if enhanced["status"] == "matched_sku" and enhanced["sku_id"]:
            votes = {enhanced["sku_id"]: [1, enhanced]}
    if retry and not votes and visual and plain_score(visual) > plain_score(best):
        best = visual
        if visual["sku_id"]:
            votes = {visual["sku_id"]: [1, visual]}
    if votes:
        best = max(votes.values(), key=lambda v: (v[0], plain_score(v[1])))[1]
    return best["status"], best["sku_id"], best["text"], used, {k: v[0] for k, v in votes.items()}


def test_recognition_of_objects(spark):
    rng = random.Random(3)

    def read(phase, idx):
        status = rng.choice(["matched_sku", "brand_only", "category_only", "unknown"]) if phase != "visual" else rng.choice(["brand_only", "unknown"])
        sku = rng.choice(["a", "b", "c", ""]) if status == "matched_sku" else rng.choice([None, "v"]) if phase == "visual" else None
        return {"phase": phase, "idx": idx, "status": status, "sku_id": sku, "confidence": rng.randrange(100) / 100, "text": "t" * rng.randrange(9)}

    rows, want = [], {True: {}, False: {}}
    for o in range(300):
        crops = [read("crop", i) for i in range(rng.randint(1, 5))]
        e, v = (read("enhanced", 0) if rng.random() < 0.7 else None), (read("visual", 0) if rng.random() < 0.7 else None)
        rows += [{"object_id": o, **r} for r in [*crops, *filter(None, (e, v))]]
        for retry in want:
            want[retry][o] = plain_recognition(crops, e, v, retry)
    df = spark.createDataFrame(rows, "object_id long, phase string, idx int, status string, sku_id string, confidence double, text string")
    for retry in want:
        got = {r["object_id"]: (r["status"], r["sku_id"], r["text"], r["n_crops"], r["sku_votes"]) for r in objects.recognise(df, ["object_id"], retry).collect()}
        assert got == want[retry]


def test_digest_and_reading_score():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (48, 72, 3)).astype(np.uint8)
    small = pixels.area_shrink(rgb, 24, 24)
    assert np.allclose(small, rgb.reshape(24, 2, 24, 3, 3).mean(axis=(1, 3)))
    assert pixels.digest(rgb) == pixels.digest(rgb.copy()) != pixels.digest(255 - rgb)
    assert pixels.digest(np.zeros((30, 30, 3), np.uint8)) == hashlib.sha1(bytes(576)).hexdigest()[:12]
    page = np.full((60, 60), 220, np.uint8)
    flat = pixels.reading_score(page)
    for y in range(10, 50, 12):
        for x in range(8, 52, 8):
            page[y : y + 6, x : x + 4] = 20
    assert flat == 0 and pixels.reading_score(page) > 100
    assert pixels.reading_score(np.zeros((2, 5), np.uint8)) == 0


def test_components_of_masks():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((12, 15)) < 0.35
        left, sizes = {tuple(p) for p in np.argwhere(mask).tolist()}, []
        while left:
            todo, seen = [left.pop()], []
            while todo:
                y, x = todo.pop()
                seen.append((y, x))
                for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if p in left:
                        left.remove(p)
                        todo.append(p)
            a = np.array(seen)
            sizes.append([*(a.max(axis=0) - a.min(axis=0) + 1).tolist(), len(seen)])
        assert sorted(pixels.components(mask).tolist()) == sorted(sizes)


def test_motion_of_frames(spark):
    rng = np.random.default_rng(3)
    scene = rng.integers(0, 256, (80, 80)).astype(np.uint8)
    # the window moves by four to the right, then a flat frame falls back on the turn
    frames = [(0, 0, scene[20:60, 20:60]), (1, 0, scene[20:60, 24:64]), (2, 0, np.full((40, 40), 9, np.uint8)), (3, 0, scene[20:60, 20:50])]
    rows = [("s", n, bytearray(f.tobytes()), f.shape[0], f.shape[1], rot, 0.11, 0.085) for n, rot, f in frames]
    df = spark.createDataFrame(rows, "session_id string, seq long, luma binary, h int, w int, rotation int, dyaw double, dpitch double")
    got = [r for r in live.motion(df).orderBy("seq").collect()]
    assert (got[0]["dx"], got[0]["dy"], got[0]["confidence"]) == (0, 0, 0)
    dx, dy, sure = pixels.block_match(frames[0][2], frames[1][2])
    assert abs(dx) == 4 and dy == 0 and sure >= live.LEAST_MATCH
    assert got[1]["dx"] == -dx / 40 and got[1]["dy"] == 0 and got[1]["cx"] == dx / 40
    assert abs(got[2]["dx"] - 0.1) < 1e-9 and abs(got[2]["dy"] + 0.1) < 1e-9
    assert got[3]["dx"] == 0  # of another size


def test_small_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("c")).first()["c"]

    spans = [("a.mov", ("a.mov", None, None)), ("a.mov:3-5.5", ("a.mov", 3.0, 5.5)), ("c:/a.mov:-5", ("c:/a.mov", 0.0, 5.0)), ("c:/a.mov", ("c:/a.mov", None, None)), ("a:2-", ("a", 2.0, 0.0))]
    for raw, want in spans:
        assert tuple(value(text.video_span(F.lit(raw)))) == want
    for raw, want in (("ЗУБР", "zubr"), ("TEK", "tek"), ("tek", "tek"), ("Ёж 1", "ezh_1"), ("!!", "unknown")):
        assert value(text.class_slug(F.lit(raw))) == want
    assert value(web.path_depth(F.lit("https://a.example/b/c/?q=/"))) == 3
    assert tuple(value(geometry.camera_roi(F.lit(100), F.lit(200)))) == (0, 36, 100, 120)
    assert tuple(value(geometry.camera_roi(F.lit(200), F.lit(100)))) == (0, 14, 200, 50)


def test_data_yaml_is_written_and_read(spark, tmp_path):
    classes = spark.createDataFrame([(1, "b: c"), (0, "a")], "place long, name string")
    for i, (given, root) in enumerate([("sets/x", "/d/sets/x"), ("/abs", "/abs"), (".", "/d"), ("s3://b/x", "s3://b/x")]):
        at = str(tmp_path / str(i))
        reports.write_document(reports.data_yaml(classes, given), at)
        assert {tuple(r) for r in readers.data_yaml(spark, at, "/d").collect()} == {(0, "a", root), (1, "b: c", root)}
    (tmp_path / "no").write_text("names:\n  0: a\n")
    assert [tuple(r) for r in readers.data_yaml(spark, str(tmp_path / "no"), "/d").collect()] == [(0, "a", "/d")]


def test_reference_index_needs_one_dimension(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "a", [0.0, 0.0]), (3, "b", [1.0])], "id long, brand_id string, embedding array<double>")
    reports.write_index(df.where("id < 3"), str(tmp_path / "good"))
    got = readers.reference_index(spark, str(tmp_path / "good")).collect()
    assert [(r["id"], r["embedding"]) for r in got] == [(1, [0.6, 0.8])]
    reports.write_index(df, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        readers.reference_index(spark, str(tmp_path / "bad"))


def test_tasks_and_counters(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("a",)], "image_id string")
    manifest = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "image_id string, label_path string")
    found, counts = datasets.tasks_with_manifest(tasks, manifest)
    assert found.count() == 2 and tuple(counts.first()) == (2, 3)
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    labels = spark.createDataFrame([("a", 0, True), ("a", 1, False)], "image_id string, cls int, manual boolean")
    assert tuple(datasets.label_counters(images, labels).first()) == (2, 1, 1, 1, 2, 1, 1)
    assert datasets.label_counters(images.limit(0), labels.limit(0)).first()["images"] == 0


def test_similar_brands_equal_all_pairs(spark):
    """Pairs of letters lose no brand that the ratio reaches."""
    from difflib import SequenceMatcher

    from shelfspark.operators import recognize

    rng = random.Random(5)
    brands = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 14))) for _ in range(60)]
    words = []
    for b in brands:
        w = list(b)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice("abcdefgh")], [w[i], "x"]])
        words.append("".join(w))
    b = spark.createDataFrame([(x, x, i) for i, x in enumerate(brands)], "brand_canon string, brand string, ord int")
    t = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "text_id int, tokens array<string>")
    got = {r["text_id"]: (r["brand"], r["ratio"]) for r in recognize.fuzzy_brands(t, b).collect()}
    want = {}
    for i, w in enumerate(words):
        rated = [(-SequenceMatcher(None, w, x).ratio(), -len(x), n, x) for n, x in enumerate(brands) if len(w) >= 5]
        if rated and -min(rated)[0] >= recognize.FUZZY:
            want[i] = (min(rated)[3], -min(rated)[0])
    assert got == want


def test_groups_over_many_batches(spark):
    """A group that Arrow hands over in parts is worked on as a whole."""
    from shelfspark.operators import sequence

    rng = random.Random(9)
    rows = [(g, i, *(float(x) for x in (a, b, a + rng.randint(5, 40), b + rng.randint(5, 40))), rng.random()) for g, n in ((1, 1), (2, 40), (3, 2), (4, 33)) for i in range(n) for a, b in [(rng.randint(0, 60), rng.randint(0, 60))]]
    df = spark.createDataFrame(rows, "image_id int, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    want = {(r["image_id"], r["ord"]) for r in sequence.nms(df, ["image_id"], 0.4).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in ("1", "3", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert {(r["image_id"], r["ord"]) for r in sequence.nms(df.coalesce(1), ["image_id"], 0.4).collect()} == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
