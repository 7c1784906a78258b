"""Crawls, sitemaps, ledgers and the streaming track fold: results against plain
versions, restarts in the middle, and how much is written."""

import random
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import crawl, datasets
from shelfspark.sources import reports
from shelfspark.sources.ledger import Ledger, write_batches
from shelfspark.streaming import live
from shelfspark.streaming import tracks as streamed


class Stop(Exception):
    pass


# --- crawl -------------------------------------------------------------------------


def plain_crawl(seeds, links, most=None):
    """Pages in the order of a queue, with their depth."""
    out, seen, queue = [], set(), deque((s, 0) for s in dict.fromkeys(seeds))
    queued = set(seeds)
    while queue and (most is None or len(out) < most):
        url, depth = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        out.append((url, depth))
        for dst in links.get(url, []):
            if dst not in seen and dst not in queued:
                queued.add(dst)
                queue.append((dst, depth + 1))
    return out


def web(seed, n=60):
    rng = random.Random(seed)
    return {str(i): [str(rng.randrange(n)) for _ in range(rng.choice([0, 1, 3, 9]))] for i in range(n)}


def frames(spark, seeds, links):
    rows = [(src, dst, i) for src, many in links.items() for i, dst in enumerate(many)]
    return spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "url string, ord int"), spark.createDataFrame(rows, "src string, dst string, ord int")


@pytest.mark.parametrize("most", [None, 1, 17])
def test_crawl_is_that_of_a_queue(spark, most):
    links = web(3)
    seeds, rows = frames(spark, ["7", "3", "7"], links)
    got = crawl.crawl(seeds, rows, most).orderBy("depth", "ord").collect()
    assert [(r["url"], r["depth"]) for r in got] == plain_crawl(["7", "3"], links, most)


def test_crawl_goes_on_after_a_stop_and_writes_only_what_is_new(spark, tmp_path):
    n = 40
    links = {str(i): [str(i + 1), "0", str(i)] for i in range(n)}  # a chain with links back
    seeds, rows = frames(spark, ["0"], links)
    folder = str(tmp_path / "crawl")
    real, count = Ledger.put, 0

    def put(self, df, name, before_commit=None):
        nonlocal count
        count += 1

        def stop(_):
            if count == 20:
                raise Stop

        return real(self, df, name, stop)

    Ledger.put = put
    try:
        with pytest.raises(Stop):
            crawl.crawl(seeds, rows, folder=folder)
        assert 0 < Ledger(spark, folder).read(seeds.withColumn("depth", F.lit(0)).schema).count() < n
        got = crawl.crawl(seeds, rows, folder=folder).orderBy("depth").collect()
    finally:
        Ledger.put = real
    assert [(r["url"], r["depth"]) for r in got] == [(str(i), i) for i in range(n + 1)]
    assert len(list(Path(folder, "done").iterdir())) < 2 * crawl.MERGED and not list(Path(folder, "staged").iterdir())
    assert count < 1.3 * n  # a batch for each round, one for eight, one for the stop


def test_crawl_of_nothing_and_of_nulls(spark):
    seeds, rows = frames(spark, ["a"], {"a": ["b", None], "b": []})
    assert {(r["url"], r["depth"]) for r in crawl.crawl(seeds, rows.where("dst IS NOT NULL")).collect()} == {("a", 0), ("b", 1)}
    assert crawl.crawl(seeds.where("false"), rows).collect() == []


def test_products_by_where_they_are_first_found(spark):
    seeds, rows = frames(spark, ["a"], {"a": ["b", "c"], "b": ["d"], "c": ["d"]})
    pages = crawl.crawl(seeds, rows)
    _, shown = frames(spark, [], {"a": ["p1"], "c": ["p3", "p1"], "b": ["p2", "p3"], "z": ["p9"]})
    assert [r["url"] for r in crawl.products(pages, shown).orderBy("depth", "page_ord", "ord").collect()] == ["p1", "p2", "p3"]
    assert [r["url"] for r in crawl.products(pages, shown, 2).collect()] == ["p1", "p2"]


def test_sitemaps_nest_repeat_and_turn_back(spark):
    def index(*locs):
        return "<?xml version='1.0'?><sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in locs) + "</sitemapindex>"

    def urls(*locs):
        return "<urlset>" + "".join(f"<url><loc>{x}</loc><priority>1</priority></url>" for x in locs) + "</urlset>"

    files = [
        ("root", index("m1", "m2", "gone", "root", "bad", "one")),
        ("m1", index("x", "m2", "y")),
        ("m2", urls("u5", "u1", "")),
        ("x", urls("u1", "u2&amp;v=1")),
        ("y", urls("u2&amp;v=1", "u3")),
        ("one", urls("u9")),
        ("bad", "<urlset><url>"),
        ("none", None),
        ("never", urls("u0")),
    ]
    docs = spark.createDataFrame(files, "url string, body string")
    got = crawl.sitemap_urls(spark.createDataFrame([("root", 0), ("none", 1)], "url string, ord int"), docs)
    assert [r["url"] for r in got.orderBy("n").collect()] == ["u1", "u2&v=1", "u3", "u5", "u9"]
    assert crawl.sitemap_urls(spark.createDataFrame([("gone", 0)], "url string, ord int"), docs).collect() == []


# --- ledger ------------------------------------------------------------------------


def test_a_killed_writer_loses_and_doubles_nothing(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 7 AS k")
    for i in range(5):
        rows.where(f"id % 5 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def stream():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def kill(name):
        if name.endswith("2"):
            raise Stop("killed between staging and commit")

    with pytest.raises(Exception, match="killed"):
        write_batches(stream(), out, ckpt, before_commit=kill).awaitTermination()
    ledger = Ledger(spark, out)
    assert ledger.committed() == ["batch-000000000", "batch-000000001"] and list(Path(out, "staged").iterdir())
    assert ledger.read(rows.schema).count() == 40  # what is only staged is not seen
    write_batches(stream(), out, ckpt).awaitTermination()
    assert not list(Path(out, "staged").iterdir()) and len(ledger.committed()) == 5
    assert sorted(r["id"] for r in ledger.read(rows.schema).collect()) == list(range(100))
    assert ledger.put(rows, "batch-000000003") == -1 and ledger.read(rows.schema).count() == 100


def test_a_commit_never_replaces_a_batch(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    a, _ = ledger.stage(spark.range(3), "b")
    b, _ = ledger.stage(spark.range(9), "b")
    assert ledger.commit(a, "b") and not ledger.commit(b, "b")
    assert ledger.read(spark.range(1).schema).count() == 3
    assert ledger.read(spark.range(1).schema, []).count() == 0


def test_jobs_of_a_repeated_batch_are_stored_once(spark, tmp_path):
    events = spark.createDataFrame([("a", "pending"), ("b", "pending")], "job_id string, sku_status string")
    events.write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        live.run_jobs(stream, lambda job: job * 2, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    run()
    for f in Path(tmp_path / "ck" / "commits").glob("*0*"):  # as if it had been killed after its commit
        f.unlink()
    run()
    assert sorted((r["job_id"], r["sku_report"]) for r in live.job_results(spark, str(tmp_path / "out")).collect()) == [("a", "aa"), ("b", "bb")]


# --- tracks ------------------------------------------------------------------------


def plain_tracks(rows, gap, k, min_frames, min_peak):
    out, open_ = [], {}

    def end(key, some):
        crops = sorted(((q, f) for f, _, q in some), key=lambda c: (-c[0], c[1]))[:k]
        if len(some) >= min_frames and max(c for _, c, _ in some) >= min_peak:
            out.append((*key, len(some), some[0][0], some[-1][0], max(c for _, c, _ in some), crops[0][1], tuple(f for _, f in crops)))

    for video, track, frame, conf, quality in sorted(rows, key=lambda r: r[2]):
        some = open_.setdefault((video, track), [])
        if some and frame - some[-1][0] > gap:
            end((video, track), some)
            some.clear()
        some.append((frame, conf, quality))
    for key, some in open_.items():
        end(key, some)
    return sorted(out)


SCHEMA = "video string, track_id long, frame long, conf double, quality double"
END = 10**9


def fold(spark, base, rows, parts, gap, **limits):
    data = sorted(rows, key=lambda r: r[2]) + [("", -1, END, 0.0, 0.0)]  # time goes on
    size = -(-len(data) // parts)
    for i in range(0, len(data), size):
        spark.createDataFrame(data[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streamed.tracks_of_files(stream, f"{base}/out", f"{base}/ckpt", gap, **limits).awaitTermination()
    got = Ledger(spark, f"{base}/out").read(spark.createDataFrame([], streamed.OUT).schema).collect()
    return sorted((r["video"], r["track_id"], r["n_frames"], r["first_frame"], r["last_frame"], r["peak_conf"], r["best_frame"], tuple(c["frame"] for c in r["crops"])) for r in got)


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_tracks_equal_plain(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(f"v{rng.randrange(2)}", rng.randrange(3), f, round(rng.random() * 0.6, 3), rng.choice([0.1, 0.5, 0.5, 0.9])) for f in sorted(rng.sample(range(1500), 240))]
    want = plain_tracks(rows, 40, 3, 3, 0.35)
    assert len(want) > 10
    assert fold(spark, str(tmp_path), rows, parts, 40, k=3) == want


def test_late_rows_are_left_out_and_state_ends(spark, tmp_path):
    base = str(tmp_path)
    parts = [[("v", 1, f, 0.9, float(f)) for f in (1, 2, 3)], [("v", 2, 500, 0.9, 1.0), ("v", 3, None, 0.9, 1.0), (None, 1, 501, 0.9, 1.0)], [("v", 2, 501, None, None)], [("v", 1, 4, 0.9, 9.0), ("v", 2, 502, 0.5, 1.0)], [("", -1, END, 0.0, 0.0)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = streamed.tracks_of_files(stream, f"{base}/out", f"{base}/ckpt", 40)
    query.awaitTermination()
    got = {(r["track_id"], r["n_frames"], r["last_frame"]) for r in Ledger(spark, f"{base}/out").read(spark.createDataFrame([], streamed.OUT).schema).collect()}
    assert got == {(1, 3, 3), (2, 3, 502)}
    held = spark.read.format("statestore").option("path", f"{base}/ckpt").option("stateVarName", "sums").load()
    assert [r["key"]["video"] for r in held.select("key").collect()] == [""]  # only what made time go on


def test_open_tracks_of_a_video_share_a_state_of_bounded_size(spark, tmp_path):
    base, tracks = str(tmp_path), [-1, 0, 7, 63, 64, 500]
    for part in ([("v", t, 1, 0.9, 1.0) for t in tracks], [("v", t, 2 + 30 * (t > 60), 0.9, 2.0) for t in tracks], [("v", 500, 60, 0.1, 2.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streamed.tracks_of_files(stream, f"{base}/out", f"{base}/ckpt", 40, k=2, min_frames=2).awaitTermination()
    got = Ledger(spark, f"{base}/out").read(spark.createDataFrame([], streamed.OUT).schema).collect()
    assert {(r["track_id"], r["n_frames"], r["best_frame"]) for r in got} == {(-1, 2, 2), (0, 2, 2), (7, 2, 2)}
    held = spark.read.format("statestore").option("path", f"{base}/ckpt").option("stateVarName", "sums").load().select("value.tracks").collect()
    assert sorted(sorted(t["track"] for t in r["tracks"]) for r in held) == [[63], [64], [500]]


# --- capped scans --------------------------------------------------------------------


@pytest.mark.parametrize(("scanned", "target", "files"), [(1000, 12, 3), (25, 100, 3), (1000, 1000, 10), (10, 5, 1)])
def test_a_scan_leaves_files_unopened(spark, tmp_path, scanned, target, files):
    rows = spark.range(100).selectExpr("id", "id % 2 = 0 AS even")
    rows.repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "in"))
    reports.in_time_order(spark, str(tmp_path / "in"))
    parts = sorted((tmp_path / "in").glob("part-*"))
    times = [p.stat().st_mtime for p in parts]
    import os

    for p, t in list(zip(parts, times))[files:]:  # whoever opens them fails
        p.write_bytes(b"broken")
        os.utime(p, (t, t))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = [i for i in range(100)[:scanned] if i % 2 == 0][:target]
    for _ in range(2):  # started again: nothing is read, nothing is added
        got = datasets.scan_files(stream, F.col("even"), scanned, target, str(tmp_path / "scan"))
        assert sorted(r["id"] for r in got.collect()) == want
