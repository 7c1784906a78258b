"""Operators against small plain versions, and the driver's contract."""

import json
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.functions import geometry as G
from shelfspark.functions import pixels
from shelfspark.functions import vectors as V
from shelfspark.operators import audit, datasets, evaluate, folder, graph, sequence, vectorsearch
from shelfspark.sources import readers
from shelfspark.streaming import live

ROOT = Path(__file__).resolve().parent.parent
BOX = "image_id long, ord long, x1 double, y1 double, x2 double, y2 double, score double, cls int, manual boolean, anchor boolean, is_truth boolean"


def random_boxes(seed, images=6, n=14):
    rng = random.Random(seed)
    out = []
    for im in range(images):
        for o in range(rng.randint(1, n)):
            x, y = rng.randrange(0, 60, 5), rng.randrange(0, 60, 5)
            out.append((im, o, float(x), float(y), float(x + rng.randrange(0, 50, 5)), float(y + rng.randrange(5, 50, 5)), rng.choice([0.1, 0.5, 0.9]), rng.randrange(2), rng.random() < 0.4, rng.random() < 0.5, rng.random() < 0.5))
    return out


def iou(a, b, eps=0.0):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = max(0.0, w) * max(0.0, h)
    union = sum((x[4] - x[2]) * (x[5] - x[3]) for x in (a, b)) - both
    return both / (union + eps) if eps or union > 0 else 0.0


def by_image(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out.values()


def kept(df):
    return {(r["image_id"], r["ord"]) for r in df.collect()}


@pytest.mark.parametrize("keep_equal", [False, True])
def test_nms(spark, keep_equal):
    rows = random_boxes(1)
    want = set()
    for g in by_image(rows):
        have = []
        for b in sorted(g, key=lambda r: (-r[6], r[1])):
            if all((iou(b, k) <= 0.5) if keep_equal else (iou(b, k) < 0.5) for k in have):
                have.append(b)
        want |= {(b[0], b[1]) for b in have}
    df = spark.createDataFrame(rows, BOX)
    got = sequence.nms(df, ["image_id"], 0.5, keep_equal)
    assert kept(got) == want
    assert kept(sequence.nms(got, ["image_id"], 0.5, keep_equal)) == want  # nothing more goes
    assert sequence.nms(df.limit(0), ["image_id"], 0.5).count() == 0
    assert kept(sequence.nms(df.repartition(13), ["image_id"], 0.5, keep_equal)) == want


def test_contain_suppress(spark):
    rows, want = random_boxes(2), set()
    size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    for g in by_image(rows):
        have = []
        for b in sorted(g, key=lambda r: (-size(r), r[1])):
            drop = False
            for k in have:
                w, h = min(b[4], k[4]) - max(b[2], k[2]), min(b[5], k[5]) - max(b[3], k[3])
                both = max(0, w) * max(0, h)
                drop = drop or both > 0 and (both / (size(b) + 1e-6) > 0.8 or both / (size(b) + size(k) - both + 1e-6) > 0.7)
            if not drop:
                have.append(b)
        want |= {(b[0], b[1]) for b in have}
    assert kept(sequence.contain_suppress(spark.createDataFrame(rows, BOX), ["image_id"])) == want


def test_match_counts_and_summary(spark):
    rows, want = random_boxes(3), {}
    for g in by_image(rows):
        gt, pred = [r for r in g if r[10]], [r for r in g if not r[10]]
        pairs = sorted((-iou(p, t, 1e-6), i, j) for i, p in enumerate(pred) for j, t in enumerate(gt))
        ui, uj = set(), set()
        for s, i, j in pairs:
            if -s >= 0.3 and i not in ui and j not in uj:
                ui.add(i)
                uj.add(j)
        want[g[0][0]] = (len(gt), len(pred), len(uj))
    rows_df = sequence.match_counts(spark.createDataFrame(rows, BOX), "image_id", 0.3)
    assert {r["image_id"]: (r["gt"], r["pred"], r["tp"]) for r in rows_df.collect()} == want
    total = evaluate.detector_summary(rows_df).first()
    assert total["tp"] == sum(t for *_, t in want.values()) and total["fn"] == total["gt"] - total["tp"]


def test_override_merge_and_anchors(spark):
    rows = random_boxes(4)
    want, anchors = [], set()
    for g in by_image(rows):
        have = [r for r in g if not r[8]]
        for m in (r for r in g if r[8]):
            if not any(r[7] == m[7] and iou(r, m) > 0.65 for r in have):
                have = [r for r in have if not (r[7] != m[7] and iou(r, m) > 0.35)] + [m]
        want += [(r[0], r[1]) for r in have]
        seen = [r for r in g if not r[9]]
        for a in (r for r in g if r[9]):
            if not any(iou(a, s) > 0.35 for s in seen):
                seen.append(a)
                anchors.add((a[0], a[1]))
    df = spark.createDataFrame(rows, BOX)
    assert Counter((r["image_id"], r["ord"]) for r in sequence.override_merge(df, "image_id").collect()) == Counter(want)
    assert kept(sequence.text_anchors(df, "image_id")) == anchors


def test_keep_if_changed_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([("v", i, [float(x)]) for i, x in enumerate([0, 3, 6, 7, 20, 22, 26])], "image_id string, ord long, v array<double>")
    assert {o for _, o in kept(sequence.keep_if_changed(df, "image_id", "v", 5.0))} == {0, 2, 4, 6}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    got = {r["node"]: r["root"] for r in graph.components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}


def test_repass_merges_only_after_a_gap(spark):
    v = [1.0, 0.0]
    rows = [("v", 0, 0, 10, v), ("v", 1, 5, 12, v), ("v", 2, 22, 30, v), ("v", 3, 21, 30, v), ("v", 4, 40, 50, [0.0, 1.0])]
    t = spark.createDataFrame(rows, "video string, ord long, first long, last long, v array<double>")
    got = {(r["a_ord"], r["b_ord"]) for r in vectorsearch.repass_edges(t, "video").collect()}
    assert got == {(0, 2)}  # 0-3 is 11 frames apart, 1-2 is 10, 0-1 and 2-3 overlap


def test_reference_search_margin(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), f"p{i % 3}") for i in range(60)]
    index = spark.createDataFrame(rows, "row_id long, v array<double>, product_key string")
    q = spark.createDataFrame([(0, rows[5][1])], "query_id long, q array<double>")
    got = vectorsearch.reference_search(q, index, k=1, prefetch=8).collect()
    unit = np.array([r[1] for r in rows]) / np.linalg.norm([r[1] for r in rows], axis=1)[:, None]
    s = unit @ unit[5]
    near = np.argsort(-s)[:8]
    best = sorted({rows[i][2]: s[i] for i in near[::-1]}.values(), reverse=True)
    assert got[0]["row_id"] == 5 and abs(got[0]["margin"] - (best[0] - (best[1] if len(best) > 1 else 0))) < 1e-9
    one = vectorsearch.reference_search(q, index.where("product_key = 'p2'"), k=5).collect()
    assert len(one) == 1 and one[0]["margin"] == one[0]["score"]


def test_reference_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=3).tolist() for _ in range(300)]
    vectors[40:90] = [vectors[0]] * 50  # equal scores go by row_id
    vectors[90:95] = [None, [1.0, None, 0.0], [1.0, 2.0], [], [float("nan"), 1.0, 0.0]]
    index = spark.createDataFrame([(i, v, f"p{i % 7}") for i, v in enumerate(vectors)], "row_id long, v array<double>, product_key string")
    q = index.where("row_id % 2 = 0").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    scored = q.select("query_id", V.unit("q").alias("q")).crossJoin(index.withColumn("v", V.unit("v"))).withColumn("score", V.dot("q", "v"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    plain = scored.withColumn("n", n).where("n <= 8").select("query_id", "row_id", "product_key", "score")
    want = Counter(map(str, plain.collect()))
    monkeypatch.setattr(vectorsearch, "SHARD_ROWS", 64)
    got = vectorsearch._nearest(q, index, 8).withColumn("n", n).where("n <= 8").drop("n")
    assert Counter(map(str, got.collect())) == want


def test_every_twentieth_vector_is_asked(spark, small):
    from shelfspark.plans import box_queries

    e = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in e], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = {}
    for i in range(len(e)):
        if e[i]["vec_id"] % 20:
            continue
        s, best = v @ v[i], {}
        for j in np.argsort(-s, kind="stable")[:40]:
            best.setdefault(e[j]["label"], (e[j]["vec_id"], s[j]))
        want |= {(e[i]["vec_id"], rank, label, row): x for rank, (label, (row, x)) in enumerate(list(best.items())[:5], 1)}
    got = {(r["query_id"], r["rank"], r["product_key"], r["row_id"]): r["score"] for r in box_queries.vector_topk_margin(spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    asked = {r["vec_id"] for r in e if r["vec_id"] % 20 == 0}
    assert {r["query_id"] for r in box_queries.visual_recognition(spark, small).collect()} == asked and max(asked) >= 20


def test_presence_first_and_best(spark):
    rows = [
        ("v", 1, 1, "matched_sku", False, "b", "m", "c", None, None, 0.8, "x", "c1"),
        ("v", 2, 2, "matched_sku", True, "b", "m", "c2", None, None, 0.9, "y", "c2"),
        ("v", 3, 3, "matched_sku", True, "b", "m", "c2", None, None, 0.9, "z", "c3"),
        ("v", 4, 4, "matched_sku", True, "b", "m", "c2", "s", "a", 0.7, "z", "c4"),
        ("v", 5, 5, "brand_only", True, None, "m", "cat", None, None, 0.1, "z", "c5"),
        ("v", 6, 6, "category_only", True, None, "m", None, None, None, 0.1, "z", "c6"),
    ]
    items = spark.createDataFrame(rows, "video string, ord long, object_id long, status string, is_own boolean, brand string, model string, category string, sku_id string, article_codes string, ocr_conf double, method string, crop string")
    r = audit.sku_presence(items).collect()
    assert len(r) == 1 and (r[0]["sku_key"], r[0]["is_own"], r[0]["category"], r[0]["best_crop"], r[0]["evidence_objects"], r[0]["object_ids"]) == ("b|m", False, "c", "c2", 3, [1, 2, 3])
    p = audit.brand_category_presence(items).collect()
    assert len(p) == 1 and p[0]["bc_key"] == "|cat"
    t = audit.totals(items).first()
    assert (t["unique_skus"], t["unique_own_skus"], t["needs_review"], t["candidate_objects"]) == (1, 0, 3, 6)


def test_coverage_rules(spark):
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None), ("c", None), ("d", "9")], "video string, sku string")
    pred = spark.createDataFrame([("a", "2"), ("a", "9"), ("c", "5"), ("z", "1")], "video string, sku string")
    got = {r["video"]: (r["matched_skus"], r["extra_skus"], r["missing_skus"], r["precision"], r["recall"]) for r in evaluate.coverage(truth, pred).collect()}
    assert got == {"a": (1, 1, 1, 0.5, 0.5), "b": (0, 0, 0, 1.0, 1.0), "c": (0, 1, 0, 0.0, 1.0), "d": (0, 0, 1, 0.0, 0.0)}
    micro = evaluate.coverage_micro(evaluate.coverage(truth, pred)).first()
    assert (micro["matched_skus"], micro["extra_skus"], micro["missing_skus"]) == (1, 2, 2)
    errors = evaluate.count_errors(spark.createDataFrame([("a", 0), ("b", 4), ("c", 1)], "video string, true_objects long"), spark.createDataFrame([("a", 2), ("b", 5)], "video string, predicted_objects long"))
    assert {r["video"]: r["count_error"] for r in errors.collect()} == {"a": 1.0, "b": 0.25}


def test_folder_audit(spark):
    paths = ["sku_exact_areas/sku_exact_zone_1.jpg", "sku_uncertain_areas/sku_uncertain_zone_1.jpg", "reports/x.jpg", "a.txt"]
    obs = folder.observe(folder.evidence(spark.createDataFrame([(p,) for p in paths], "path string")))
    assert [(r["observation_id"], r["zone_type"], r["status"]) for r in obs.orderBy("path").collect()] == [("obs_000001", "exact", "brand_only"), ("obs_000002", "uncertain", "needs_retake")]
    s = folder.audit_summary(obs).first()
    assert (s["total_evidence_files"], s["exact_zone_files"], s["uncertain_zone_files"]) == (2, 1, 1)
    store = folder.observe(folder.evidence(spark.createDataFrame([("ТТ Example/IMG_0001.HEIC",)], "path string")))
    s = folder.audit_summary(store).first()
    assert (s["store_count"], s["market_photo_files"], s["pending_analysis_observations"]) == (1, 1, 1) and store.first()["status"] == "pending_analysis"
    m = spark.createDataFrame([(1200, 900, 120.0, 0.0, 0.0), (800, 900, 230.0, 30.0, 9.0), (1000, 1000, 100.0, 30.0, 9.0)], "width int, height int, brightness double, contrast double, sharpness double")
    state, issues = folder.quality_status()
    assert [(r[0], r[1]) for r in m.select(state, issues).collect()] == [("retake", ["low_contrast", "blurred"]), ("warning", ["low_resolution", "very_bright"]), ("ok", ["acceptable"])]


def test_image_measures(spark, tmp_path):
    flat = np.full((64, 64, 3), 120, np.uint8)
    assert pixels.quality(pixels.grey(flat)) == (120.0, 0.0, 0.0)
    assert pixels.signature(pixels.grey(flat)) is None and pixels.plain_background(flat)
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 255, (64, 64, 3), dtype=np.uint8)
    sig = pixels.signature(pixels.grey(noise))
    assert abs(np.linalg.norm(sig) - 1) < 1e-9 and abs(sig.sum()) < 1e-9 and not pixels.plain_background(noise)
    luma = pixels.grey(rng.integers(0, 255, (60, 80, 3), dtype=np.uint8))
    moved = np.roll(luma, (4, -6), axis=(0, 1))
    dx, dy, sure = pixels.block_match(luma, moved)
    assert (dx, dy) == (6, -4) and sure > 0.9
    import struct
    import zlib

    raw = b"".join(b"\x00" + noise[y].tobytes() for y in range(64))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 64, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    im = readers.images(spark, str(tmp_path))
    m = im.select(pixels.measures_udf(F.struct("origin", "height", "width", "nChannels", "mode", "data")).alias("m")).first()["m"]
    assert abs(m["brightness"] - pixels.quality(pixels.grey(noise))[0]) < 1e-9 and len(m["signature"]) == 64


def test_geometry_edges(spark):
    df = spark.createDataFrame([(-0.3, 0.75)], "cx double, cy double")
    cells = df.select(G.grid_cells("cx", "cy").alias("c")).first()["c"]
    assert {c["col"] for c in cells} == {-2, -1, 0, 1, 2} and {c["row"] for c in cells} == {3, 4, 5, 6}
    line = spark.createDataFrame([("0 .5 .5 .2 .4",), ("1 0 0 .5 0 .5 .25 0 .25",), ("bad",)], "l string").select(G.parse_label("l").alias("b")).collect()
    assert [round(line[0]["b"][k], 6) for k in ("x1", "y1", "x2", "y2")] == [0.4, 0.3, 0.6, 0.7] and line[1]["b"]["x2"] == 0.5 and line[2]["b"] is None
    p = spark.createDataFrame([([2.0, 1.0],), ([0.25, 0.75],)], "v array<double>").select(V.probabilities("v").alias("p")).collect()
    assert abs(p[0]["p"][0] - 1 / (1 + np.exp(-1))) < 1e-12 and p[1]["p"] == [0.25, 0.75]
    spans = spark.createDataFrame([(0, 5, 5, 9), (0, 4, 7, 9), (7, 9, 0, 4)], "a_first int, a_last int, b_first int, b_last int").select(G.repass_gap("a_", "b_").alias("g"))
    assert [r["g"] for r in spans.collect()] == [None, 3, 3]


def test_splits_and_quotas(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, g int")
    assert datasets.split_every(df, ["id"], ratio=0.2).where("split = 'val'").count() == 8
    assert {r["n"] for r in datasets.split_hashed(df, "id", 0.25, "s", ("g",)).where("split = 'val'").groupBy("g").agg(F.count("*").alias("n")).collect()} == {2}
    assert datasets.capped(df, ["g"], ["id"], 3, 10).count() == 10
    files = datasets.image_of_label(spark.createDataFrame([("a",), ("b",)], "stem string"), spark.createDataFrame([("a", ".png", "a.png"), ("a", ".jpg", "a.jpg")], "stem string, ext string, path string"))
    assert {r["stem"]: r["image_path"] for r in files.collect()} == {"a": "a.jpg", "b": None}


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("video,expected_skus\n/x/v1.mp4,a;b|a\n,z\nv2.mp4,\n")
    assert {(r["video"], r["sku"]) for r in readers.truth_skus(spark, str(tmp_path / "t.csv")).collect()} == {("v1.mp4", "a"), ("v1.mp4", "b"), ("v2.mp4", None)}
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/i1.txt").write_text("0 .5 .5 .2 .2\n")
    (tmp_path / "labels/i2.txt").write_text("")
    assert [r["image_id"] for r in readers.yolo_labels(spark, str(tmp_path / "labels")).collect()] == ["i1"]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> http://a/ </loc></url><url><loc>http://b/</loc></url><url><loc>http://a/</loc></url></urlset>")
    assert [r["url"] for r in readers.sitemap(spark, str(tmp_path / "s.xml")).orderBy("ord").collect()] == ["http://a/", "http://b/"]
    (tmp_path / "o.json").write_text(json.dumps({"i1": [{"class": "own", "box": [0, 0, 1, 1], "reason": "r"}]}))
    assert readers.overrides(spark, str(tmp_path / "o.json")).first()["class"] == "own"
    (tmp_path / "m").mkdir()
    for name in ("s1/a.JPG", "var/b.jpg", "s1/c.txt", "s2/v.mov"):
        (tmp_path / "m" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "m" / name).write_text("x")
    assert {r["path"] for r in readers.media_files(spark, str(tmp_path / "m")).collect()} == {"s1/a.JPG", "s2/v.mov"}
    probe = spark.createDataFrame([("v", '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":4,"height":"3"}],"format":{"duration":"9.5"}}')], "path string, probe string")
    r = readers.probe_rows(probe).first()
    assert (r["width"], r["height"], r["duration_seconds"]) == (4, 3, 9.5)


# --- live capture ---------------------------------------------------------------


def det(x, look=None, good=True):
    return {"box": [x, 0.1, x + 0.2, 0.3], "conf": 0.9, "recognized": good, "signature": look}


def test_tracker_rules():
    a, b = [1.0, 0.0], [0.0, 1.0]
    t = live.LiveTracker()
    for _ in range(8):
        out, c = t.frame([det(0.1, a), det(0.6, a)])  # two alike side by side stay two
    assert c == {"n_visible": 0, "n_captured": 2, "n_retake": 0, "n_tracked": 2}
    for _ in range(41):
        t.frame([])
    out, c = t.frame([det(0.35, a)])  # comes back elsewhere: known by its look
    assert out[0][1] is False and c["n_tracked"] == 2
    t = live.LiveTracker()
    t.frame([det(0.1, b, False)])
    for _ in range(40):
        t.frame([])
    assert len(t.tracks) == 1
    t.frame([])
    assert not t.tracks
    t.frame([det(0.1, None, False)])
    assert t.tracks[0].good == 0  # never below zero
    again = live.LiveTracker.load(t.dump())
    assert again.dump() == t.dump()


def test_feedback_buffer_rules():
    buf = live.FeedbackBuffer()
    for i in range(25):
        buf.add(i, 1000 + i, float(i == 0))
    assert len(buf.rows) == 24 and buf.rows[0][0] == 1  # the oldest went
    buf = live.FeedbackBuffer()
    buf.add(1, 0, 9.0)
    buf.add(2, 1400, 1.0)
    buf.add(3, 1401, 0.5)
    assert buf.click(2000)[0] == 2 and buf.click(2001) is None  # 1 is too far from the newest
    buf.add(4, 0, 1.0)
    assert buf.click(8000)[0] == 4
    buf.add(5, 0, 1.0)
    assert buf.click(8001) is None


def test_streams_equal_batches(spark, small):
    from shelfspark.plans import box_queries, stream_queries

    for stream, batch in ((stream_queries.stream_sessions, box_queries.live_tracker_replay), (stream_queries.stream_feedback, box_queries.feedback_replay), (stream_queries.stream_grid, box_queries.grid_cells)):
        s, b = stream(spark, small), batch(spark, small)
        assert Counter(map(tuple, s.select(b.columns).collect())) == Counter(map(tuple, b.collect()))


def test_folds(spark):
    df = spark.createDataFrame([([True] * 8 + [False],), ([False, True],)], "f array<boolean>").select(live.saturating_fold(F.col("f")).alias("s")).collect()
    assert (df[0]["s"]["n"], df[0]["s"]["captured"]) == (7, True) and (df[1]["s"]["n"], df[1]["s"]["captured"]) == (1, False)


def test_jobs_run_apart(spark, tmp_path):
    events = spark.createDataFrame([("good", "pending"), ("bad", "pending"), ("old", "done")], "job_id string, sku_status string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def work(job):
        return 1 // (job == "good")

    live.run_jobs(stream, work, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["job_id"]: r["sku_status"] for r in live.job_results(spark, str(tmp_path / "out")).collect()}
    assert got == {"good": "done", "bad": "failed"}


# --- the contract ------------------------------------------------------------------


def test_every_line_item_is_matched(spark, small):
    from shelfspark.plans import text_queries

    line = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").distinct().collect()
    part = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    keys = {k: f"{size}{k % 97}{k}" for k, size in part.items()}
    first = {key: k for k, key in sorted(keys.items(), reverse=True)}
    ident = {(r["l_orderkey"] * 10 + r["l_linenumber"]) * 1000000 + r["l_partkey"]: keys[r["l_partkey"]] for r in line}
    assert len(ident) == len(line)
    want = {(i, key, str(first[key])) for i, key in ident.items() if len(key) >= 4}
    got = text_queries.article_exact_match(spark, small).collect()
    assert len(got) == len(want) and {(r["text_id"], r["key"], r["sku_id"]) for r in got} == want
    assert {r["text_id"] for r in text_queries.match_text(spark, small).collect()} == {*ident, *(-k - 1 for k in part)}


def test_results_do_not_depend_on_partitions(spark, small):
    from shelfspark.plans import audit_queries, text_queries

    for q in (audit_queries.sku_presence, audit_queries.vote_winner, text_queries.match_text):
        one = Counter(map(str, q(spark, small).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        try:
            assert Counter(map(str, q(spark, small).collect())) == one
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_and_sql_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "shelfspark", tmp_path / "shelfspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sku_presence' in q and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-800:]


def test_command_line(spark, tmp_path):
    from shelfspark import cli

    for name in ("Store A/1.jpg", "Store A/overview.png", "sku_exact_areas/zone_1.jpg", "v.mov"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    cli.main(["audit-images", str(tmp_path / "in"), str(tmp_path / "out")])
    s = spark.read.json(str(tmp_path / "out/summary")).first()
    assert (s["total_evidence_files"], s["store_count"], s["exact_zone_files"], s["review_artifact_files"]) == (3, 1, 1, 1)
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out/report")).collect())
    assert "| Store A | 2 |" in text and "overview" not in text
    cli.main(["create-job", str(tmp_path / "in"), str(tmp_path / "jobs"), "--store", "S"])
    job = spark.read.json(str(tmp_path / "jobs")).first()
    assert (job["total"], job["image"], job["video"], job["stores"]) == (4, 3, 1, "S,Store A") and job["notes"][-1] == "video_queued"
    wanted = spark.createDataFrame([("v.mov",), ("none.mov",)], "video string")
    got = {r["video"]: r["path"] for r in cli.find_videos(readers.media_files(spark, str(tmp_path / "in")), wanted).collect()}
    assert got == {"v.mov": "v.mov", "none.mov": None}
