"""Boxes, vectors, datasets and live capture."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import text as X
from ..functions import vectors as V
from ..operators import datasets, folder, graph, sequence, tracks, vectorsearch
from ..streaming import live
from .audit_queries import _FRAMES, BOXES_SQL, _rounded, boxes, frames
from . import folds
from .registry import query, table

W, H = 1200.0, 900.0


@query(
    f"""WITH {BOXES_SQL}, p AS (SELECT a.image_id, a.ord AS a_ord, b.ord AS b_ord,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.ord < b.ord)
SELECT image_id, a_ord, b_ord, round(i / (s - i), 6) AS iou FROM p WHERE i > 0"""
)
def iou_pairs(spark, sf_dir):
    """Overlapping pairs inside one image; an image has a handful of boxes."""
    b = boxes(spark, sf_dir)
    left = b.select("image_id", *[F.col(c).alias(f"a_{c}") for c in ("ord", "x1", "y1", "x2", "y2")])
    right = b.select("image_id", *[F.col(c).alias(f"b_{c}") for c in ("ord", "x1", "y1", "x2", "y2")])
    pairs = left.join(right, "image_id").where("a_ord < b_ord AND a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    return pairs.where(G.intersection("a_", "b_") > 0).select("image_id", "a_ord", "b_ord", F.round(G.iou("a_", "b_"), 6).alias("iou"))


def _filter_sql(f: G.BoxFilter) -> str:
    return (
        f"(x2 - x1 >= {f.side} AND y2 - y1 >= {f.side} AND (x2 - x1) * (y2 - y1) / ({W} * {H}) BETWEEN {f.area[0]} AND {f.area[1]}"
        f" AND (x2 - x1) / greatest(1, y2 - y1) BETWEEN {f.aspect[0]} AND {f.aspect[1]})"
    )


@query(
    f"WITH {BOXES_SQL} SELECT image_id, ord, {_filter_sql(G.PACKAGE)} AS package, {_filter_sql(G.UNBOXED)} AS unboxed, {_filter_sql(G.PROPOSAL)} AS proposal, {_filter_sql(G.TRACKED)} AS tracked FROM boxes"
)
def box_filters(spark, sf_dir):
    kinds = {"package": G.PACKAGE, "unboxed": G.UNBOXED, "proposal": G.PROPOSAL, "tracked": G.TRACKED}
    b = boxes(spark, sf_dir).withColumns({"w": F.lit(W), "h": F.lit(H)})
    return b.select("image_id", "ord", *[f.holds("w", "h").alias(k) for k, f in kinds.items()])


@query(
    f"""WITH {BOXES_SQL}, g AS (SELECT image_id, ord, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.08) AS INTEGER)) AS cx1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.08) AS INTEGER)) AS cy1,
  least(600, CAST(trunc(x2 + (x2 - x1) * 0.08) AS INTEGER)) AS cx2, least(500, CAST(trunc(y2 + (y2 - y1) * 0.08) AS INTEGER)) AS cy2 FROM boxes)
SELECT * FROM g WHERE cx2 - cx1 >= 32 AND cy2 - cy1 >= 32 AND (cx2 - cx1) * (cy2 - cy1) / (600.0 * 500.0) BETWEEN 0.004 AND 0.45"""
)
def crop_clamp(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"w": F.lit(600.0), "h": F.lit(500.0)})
    return b.select("image_id", "ord", G.padded_crop("w", "h", 0.08, 32, (0.004, 0.45)).alias("c")).where("c IS NOT NULL").select("image_id", "ord", "c.*")


@query(
    f"""WITH {BOXES_SQL} SELECT image_id, ord, round(score / 100000 * sqrt((x2 - x1) * (y2 - y1)) * CASE WHEN x1 <= 4 OR y1 <= 4 OR x2 >= 496 OR y2 >= 496 THEN 0.7 ELSE 1.0 END, 9) AS quality FROM boxes"""
)
def crop_quality(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"w": F.lit(500.0), "h": F.lit(500.0), "conf": F.col("score") / 100000})
    return b.select("image_id", "ord", F.round(G.crop_quality("conf", "w", "h"), 9).alias("quality"))


_IN = "(i.x1 + i.x2) / 2 BETWEEN o.x1 - (o.x2 - o.x1) * {g} AND o.x2 + (o.x2 - o.x1) * {g} AND (i.y1 + i.y2) / 2 BETWEEN o.y1 - (o.y2 - o.y1) * {g} AND o.y2 + (o.y2 - o.y1) * {g}"


def _sides(spark, sf_dir):
    b = boxes(spark, sf_dir)
    cols = ("ord", "x1", "y1", "x2", "y2")
    i = b.where("NOT is_truth").select("image_id", *[F.col(c).alias(f"i_{c}") for c in cols])
    o = b.where("is_truth").select("image_id", *[F.col(c).alias(f"o_{c}") for c in cols])
    return i, o


@query(f"WITH {BOXES_SQL} SELECT i.image_id, i.ord AS i_ord, o.ord AS o_ord FROM boxes i JOIN boxes o ON i.image_id = o.image_id AND NOT i.is_truth AND o.is_truth AND {_IN.format(g=0.08)}")
def text_in_box(spark, sf_dir):
    i, o = _sides(spark, sf_dir)
    return i.join(o, "image_id").where(G.centre_inside("i_", "o_", 0.08)).select("image_id", "i_ord", "o_ord")


@query(
    f"""WITH {BOXES_SQL} SELECT image_id, ord AS i_ord FROM boxes i WHERE NOT is_truth AND NOT EXISTS (SELECT 1 FROM boxes o WHERE o.image_id = i.image_id AND o.is_truth
  AND {_IN.format(g=0)} AND (i.x2 - i.x1) * (i.y2 - i.y1) < (o.x2 - o.x1) * (o.y2 - o.y1) * 0.55)"""
)
def nested_anti(spark, sf_dir):
    i, o = _sides(spark, sf_dir)
    under = G.centre_inside("i_", "o_") & (G.area("i_") < G.area("o_") * 0.55)
    return i.join(o.withColumnRenamed("image_id", "o_image"), (F.col("image_id") == F.col("o_image")) & under, "left_anti").select("image_id", "i_ord")


def _kept(df):
    return df.select("image_id", "ord", "x1", "y1", "x2", "y2", "score")


@query(folds.nms_sql(BOXES_SQL, 0.55))
def nms(spark, sf_dir):
    return _kept(sequence.nms(boxes(spark, sf_dir), ["image_id"], 0.55))


@query(folds.contain_sql(BOXES_SQL))
def contain_suppress(spark, sf_dir):
    return _kept(sequence.contain_suppress(boxes(spark, sf_dir), ["image_id"]))


@query(folds.package_sql(BOXES_SQL, _filter_sql(G.PACKAGE), _filter_sql(G.UNBOXED), f"{_IN.format(g=0)} AND (i.x2 - i.x1) * (i.y2 - i.y1) < (o.x2 - o.x1) * (o.y2 - o.y1) * 0.55"))
def package_merge(spark, sf_dir):
    """Packages and unboxed goods filtered, suppressed, unnested, united and suppressed again."""
    b = boxes(spark, sf_dir).withColumns({"w": F.lit(W), "h": F.lit(H)})
    packages = sequence.nms(b.where("is_truth").where(G.PACKAGE.holds("w", "h")), ["image_id"], 0.65)
    loose = b.where("NOT is_truth").where(G.UNBOXED.holds("w", "h"))
    outer = packages.select(F.col("image_id").alias("o_image"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    inner = loose.withColumns({f"i_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")})
    under = (F.col("image_id") == F.col("o_image")) & G.centre_inside("i_", "o_") & (G.area("i_") < G.area("o_") * 0.55)
    free = inner.join(outer, under, "left_anti").drop(*[f"i_{c}" for c in ("x1", "y1", "x2", "y2")])
    return _kept(sequence.nms(packages.unionByName(sequence.nms(free, ["image_id"], 0.55)), ["image_id"], 0.75))


@query(folds.override_sql(BOXES_SQL))
def override_merge(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("manual", F.col("is_truth"))
    return sequence.override_merge(b, "image_id").select("image_id", "ord", "cls", "manual")


@query(folds.anchors_sql(BOXES_SQL))
def text_anchors(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("anchor", ~F.col("is_truth"))
    return sequence.text_anchors(b, "image_id").select("image_id", "ord")


@query(
    f"""WITH {BOXES_SQL}, c AS (SELECT *, greatest(0, least(1, x1 / {W})) AS a, greatest(0, least(1, y1 / {H})) AS b, greatest(0, least(1, x2 / {W})) AS c, greatest(0, least(1, y2 / {H})) AS d FROM boxes)
SELECT image_id, ord, cls, round(CAST(printf('%.6f', a) AS DOUBLE), 6) AS x1, round(CAST(printf('%.6f', b) AS DOUBLE), 6) AS y1,
  round(CAST(printf('%.6f', c) AS DOUBLE), 6) AS x2, round(CAST(printf('%.6f', d) AS DOUBLE), 6) AS y2 FROM c"""
)
def label_roundtrip(spark, sf_dir):
    """Boxes written as polygon lines of a label file and read back."""
    b = boxes(spark, sf_dir).withColumns({"w": F.lit(W), "h": F.lit(H)})
    lines = b.select("image_id", "ord", G.label_line("cls", G.polygon("w", "h")).alias("line"))
    return lines.select("image_id", "ord", G.parse_label("line").alias("b")).select("image_id", "ord", "b.*")


@query(
    f"""WITH {BOXES_SQL}, t AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(70, least(220, (x2 - x1) * CAST(1.8 AS DOUBLE))) AS bw, greatest(60, least(180, (y2 - y1) * CAST(3.4 AS DOUBLE))) AS bh FROM boxes)
SELECT image_id, ord, printf('%.6f %.6f %.6f %.6f', (x1 + x2) / 2 / {W}, (y1 + y2) / 2 / {H}, (x2 - x1) / {W}, (y2 - y1) / {H}) AS line,
  x2 - x1 >= 18 AND y2 - y1 >= 10 AND least(greatest(cx + bw / 2, 0), {W}) - least(greatest(cx - bw / 2, 0), {W}) >= 50
    AND least(greatest(cy + bh * 0.55, 0), {H}) - least(greatest(cy - bh * 0.45, 0), {H}) >= 50 AS has_anchor,
  CASE WHEN greatest(x1 / {W}, x2 / {W}, y1 / {H}, y2 / {H}) <= 1 AND abs(x2 - x1) >= 5 AND abs(y2 - y1) >= 5 THEN round(least(greatest(x1, x2), {W}), 4) END AS manual_x2 FROM t"""
)
def box_converters(spark, sf_dir):
    """Centre-and-size labels, whole pixels, text anchors and manual boxes of every box."""
    b = boxes(spark, sf_dir).withColumns({"w": F.lit(W), "h": F.lit(H)})
    share = F.array(*[F.col(c) / s for c, s in (("x1", W), ("y1", H), ("x2", W), ("y2", H))])
    return b.select(
        "image_id", "ord", F.array_join(F.transform(G.centre_size("w", "h"), lambda x: F.format_string("%.6f", x)), " ").alias("line"),
        G.text_anchor("w", "h").isNotNull().alias("has_anchor"), F.round(G.override_box(share, "w", "h")["x2"], 4).alias("manual_x2"),
    )


_TOPK = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, i.vec_id AS row_id, i.label AS product_key, list_cosine_similarity(q.e, i.e) AS score FROM v q, v i WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS n FROM s QUALIFY n <= 40),
b AS (SELECT query_id, product_key, max(score) AS score, arg_min(row_id, n) AS row_id FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS margin FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, row_id)),
top AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, product_key, row_id, round(score, 6) AS score, round(margin, 6) AS margin FROM r WHERE rank <= 5)"""


@query(f"WITH {_TOPK} SELECT * FROM top")
def vector_topk_margin(spark, sf_dir):
    """Every row whose id is divisible by 20, the fixed query set, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    index = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), F.col("label").alias("product_key"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return _rounded(vectorsearch.reference_search(q, index), "score", "margin")


@query(f"WITH {_TOPK} SELECT *, CASE WHEN score >= 0.3 AND margin >= 0.02 THEN 'brand_only' ELSE 'unknown' END AS status FROM top WHERE rank = 1")
def visual_recognition(spark, sf_dir):
    return vectorsearch.visual_recognition(vector_topk_margin(spark, sf_dir), 0.3, 0.02)


_EDGES = """v AS (SELECT label AS video, vec_id AS ord, vec_id % 50 AS first, vec_id % 50 + 3 AS last, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT a.video, a.ord AS a_ord, b.ord AS b_ord, list_cosine_similarity(a.e, b.e) AS sim, CASE WHEN a.last < b.first THEN b.first - a.last WHEN b.last < a.first THEN a.first - b.last END AS gap
  FROM v a JOIN v b ON a.video = b.video AND a.ord < b.ord),
e AS (SELECT * FROM g WHERE gap >= 12 AND sim >= 0.3)"""


def _tracks(spark, sf_dir):
    first = F.col("vec_id") % 50
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), F.col("vec_id").alias("ord"), first.alias("first"), (first + 3).alias("last"), F.col("embedding").alias("v"))


@query(f"WITH {_EDGES} SELECT video, a_ord, b_ord, round(sim, 6) AS sim, gap FROM e")
def repass_edges(spark, sf_dir):
    return _rounded(vectorsearch.repass_edges(_tracks(spark, sf_dir), "video", 0.3, 12), "sim")


_ROOTS = f"""{_EDGES}, u AS (SELECT a_ord AS a, b_ord AS b FROM e UNION ALL SELECT b_ord, a_ord FROM e),
reach(a, b) AS (SELECT ord, ord FROM v UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {_ROOTS} SELECT * FROM roots")
def reid_components(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    e = vectorsearch.repass_edges(t, "video", 0.3, 12)
    return graph.components(t.select(F.col("ord").alias("node")), e.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents", "split_every_n")
def split_every_n(spark, sf_dir):
    return datasets.split_every(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], ratio=0.2)


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s1' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN i <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def hash_split(spark, sf_dir):
    return datasets.split_hashed(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 0.2, "s1", ("source",))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 50)")
def class_min_count(spark, sf_dir):
    return datasets.with_min_count(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 50)


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit("\u0000")).cast("binary")).alias("k"))
    return datasets.first_of(d, ["k"], ["doc_id"]).select("doc_id", "source")


@query("WITH c AS (SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3) SELECT * FROM c ORDER BY value DESC, event_id LIMIT 110")
def quota_caps(spark, sf_dir):
    """Three of each video, 110 in all: the caps are the operator's."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return datasets.capped(e, ["user_id"], [F.desc("value"), "event_id"], 3, 110)


@query(
    """WITH f AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 6 AS n FROM events),
c AS (SELECT * FROM f WHERE n <= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 18) SELECT * FROM c ORDER BY user_id, event_id LIMIT 110"""
)
def negative_frames(spark, sf_dir):
    """Frames with two detections or fewer, 18 of a video and 110 in all."""
    f = table(spark, sf_dir, "events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 6).alias("n"))
    return datasets.capped(f.where("n <= 2"), ["user_id"], ["event_id"], 18, 110, ["user_id", "event_id"])


@query(
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, array_to_string(list_transform(range(0, 7), lambda i: CAST(trunc(n * CAST(0.05 AS DOUBLE) + i * (n * CAST(0.95 AS DOUBLE) - n * CAST(0.05 AS DOUBLE)) / 6) AS BIGINT)), ',') AS idx,
  array_to_string(list_transform(range(0, 3), lambda i: printf('%.3f', n / 3.0 * (i + 0.5))), ',') AS mid FROM n"""
)
def frame_sampling(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mid = F.transform(G.midpoints(F.lit(0.0), "n", 3), lambda x: F.format_string("%.3f", x))
    return n.select("user_id", "n", F.array_join(G.sample_indexes("n", 7, 0.05, 0.95), ",").alias("idx"), F.array_join(mid, ",").alias("mid"))


@query(folds.changed_sql(_FRAMES, 15.0))
def keep_if_changed(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("ord", F.col("seq")).withColumn("v", F.array("value", F.col("k").cast("double")))
    return sequence.keep_if_changed(f, "session_id", "v", 15.0).select("session_id", "seq")


@query(
    """WITH c AS (SELECT o_custkey AS image_id, o_orderpriority AS category FROM orders)
SELECT DISTINCT image_id FROM c a WHERE category IN ('1-URGENT', '2-HIGH') AND NOT EXISTS (SELECT 1 FROM c b WHERE b.image_id = a.image_id AND b.category = '5-LOW')"""
)
def category_set_semi_anti(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("category"))
    return datasets.by_category_sets(m, ["1-URGENT", "2-HIGH"], ["5-LOW"])


@query(
    """WITH d AS (SELECT lang AS split, n_chars % 4 AS boxes FROM documents)
SELECT split, count(*) AS images, count(*) FILTER (WHERE boxes > 0) AS labels, CAST(sum(boxes) AS BIGINT) AS boxes, count(*) FILTER (WHERE boxes = 0) AS empty,
  CAST(grouping(split) AS TINYINT) AS is_total FROM d GROUP BY ROLLUP (split)"""
)
def dataset_summary_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), (F.col("n_chars") % 4).alias("boxes"))
    return datasets.split_summary(d)


_LIVE = """l AS (SELECT event_id, user_id, value / 100 AS conf, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS k FROM events)"""


def _live(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 100).alias("conf"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("k"))


@query(f"WITH {_LIVE} SELECT event_id, CASE WHEN k >= 0.9 THEN 'positive' WHEN conf >= 0.3 AND k <= 0.18 THEN 'hard_negative' ELSE 'review' END AS bucket FROM l")
def guard_buckets(spark, sf_dir):
    return _live(spark, sf_dir).select("event_id", tracks.guard_bucket(F.col("k"), F.col("conf")).alias("bucket"))


_STATE = "CASE WHEN k * 0.3 < 0.026 OR k < 0.115 THEN 'FAR' WHEN conf < 0.34 THEN 'BLUR' WHEN event_id % 5 = 0 OR conf < 0.7 OR k < 0.88 OR conf < 0.44 THEN 'UNCERTAIN' ELSE 'GOOD' END"


def _states(spark, sf_dir):
    k, conf = F.col("k"), F.col("conf")
    return _live(spark, sf_dir).withColumn("state", tracks.live_quality(k * 0.3, k, conf, F.col("event_id") % 5 != 0, conf, k))


@query(f"WITH {_LIVE} SELECT event_id, {_STATE} AS state, (k * 30 < 22 AND conf * 40 < 15) OR (k * 0.1 < 0.035 AND conf * 40 < 24) OR (k * 0.2 > 0.12 AND k * 0.1 < 0.055 AND conf * 40 < 34.8) AS background FROM l")
def live_quality(spark, sf_dir):
    k, conf = F.col("k"), F.col("conf")
    return _states(spark, sf_dir).select("event_id", "state", tracks.live_background(k * 30, conf * 40, k * 0.1, k * 0.2).alias("background"))


@query(
    f"""WITH {_LIVE}, s AS (SELECT user_id, {_STATE} AS state FROM l),
c AS (SELECT user_id, count(*) FILTER (WHERE state <> 'GOOD') AS todo, count(*) FILTER (WHERE state = 'FAR') AS closer, count(*) FILTER (WHERE state = 'BLUR') AS blur,
  count(*) FILTER (WHERE state = 'UNCERTAIN') AS aim, count(*) FILTER (WHERE state = 'GOOD') AS hold FROM s GROUP BY 1)
SELECT user_id, todo, closer, blur, aim, hold, CASE WHEN todo = 0 AND hold > 0 THEN 'zone_done' WHEN todo = 0 THEN 'point_at_shelf' WHEN closer > 5 THEN 'closer' WHEN blur > 10 THEN 'slower'
  WHEN aim > 0 THEN 'aim' WHEN hold > 0 THEN 'hold' ELSE 'move_on' END AS hint FROM c"""
)
def live_hint(spark, sf_dir):
    s = F.col("state")
    c = _states(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(s != "GOOD").alias("todo"), F.count_if(s == "FAR").alias("closer"), F.count_if(s == "BLUR").alias("blur"), F.count_if(s == "UNCERTAIN").alias("aim"), F.count_if(s == "GOOD").alias("hold")
    )
    hint = tracks.live_hint(F.col("todo"), F.greatest(F.col("closer") - 5, F.lit(0)), F.greatest(F.col("blur") - 10, F.lit(0)), F.col("aim"), F.col("hold"), F.col("hold"))
    return c.withColumn("hint", hint)


_GRID = f"""{_FRAMES}, v AS (SELECT session_id, value / 40 - 1 AS cx, k / 50.0 - 1 AS cy, value / 100 AS sharpness FROM frames),
e AS (SELECT session_id, sharpness, unnest(range(CAST(floor(cx / 0.25) AS BIGINT), CAST(floor((cx + 1 - 1e-4) / 0.25) AS BIGINT) + 1)) AS col, cy FROM v),
g AS (SELECT session_id, sharpness, CAST(col AS INTEGER) AS col, CAST(unnest(range(CAST(floor(cy / 0.25) AS BIGINT), CAST(floor((cy + 1 - 1e-4) / 0.25) AS BIGINT) + 1)) AS INTEGER) AS row FROM e),
cells AS (SELECT session_id, col, row, count(*) AS frames, max(sharpness) AS best_sharpness, CASE WHEN max(sharpness) >= 0.55 THEN 'good' ELSE 'poor' END AS state FROM g GROUP BY 1, 2, 3)"""


def _views(spark, sf_dir):
    return frames(spark, sf_dir).select("session_id", "seq", (F.col("value") / 40 - 1).alias("cx"), (F.col("k") / 50.0 - 1).alias("cy"), (F.col("value") / 100).alias("sharpness"))


@query(f"WITH {_GRID} SELECT * FROM cells")
def grid_cells(spark, sf_dir):
    return live.mark_cells(_views(spark, sf_dir))


@query(
    f"""WITH {_GRID} SELECT session_id, count(*) FILTER (WHERE state = 'good') AS good, count(*) FILTER (WHERE state = 'poor') AS poor, min(col) AS min_col, max(col) AS max_col, min(row) AS min_row, max(row) AS max_row FROM cells GROUP BY 1"""
)
def grid_state(spark, sf_dir):
    return live.grid_state(live.mark_cells(_views(spark, sf_dir)))


@query(
    f"""WITH {_GRID}, p AS (SELECT session_id, col, row, (col + 0.5) * 0.25 - 0.75 AS dx, (row + 0.5) * 0.25 - 0.75 AS dy FROM cells WHERE state = 'poor')
SELECT session_id, col, row, round(dx, 6) AS dx, round(dy, 6) AS dy FROM p QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY dx * dx + dy * dy, col, row) = 1"""
)
def nearest_poor(spark, sf_dir):
    v = _views(spark, sf_dir)
    here = v.select("session_id").distinct().withColumns({"cx": F.lit(0.25), "cy": F.lit(0.25)})
    return _rounded(live.nearest_poor(live.mark_cells(v), here), "dx", "dy")


@query(
    f"""WITH {_FRAMES}, s AS (SELECT session_id, seq, value / 100 AS dx, k / 100.0 AS dy, value / 10 - lag(value / 10) OVER (PARTITION BY session_id ORDER BY seq) AS d FROM frames)
SELECT session_id, seq, round(-sum(dx) OVER w, 6) AS cx, round(sum(dy) OVER w, 6) AS cy, round(sqrt(dx * dx + dy * dy), 6) AS speed,
  round(coalesce((((d + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi(), 0), 6) AS turn FROM s WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""
)
def camera_offset(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"dx": F.col("value") / 100, "dy": F.col("k") / 100.0, "a": F.col("value") / 10}).withColumn("turn", live.wrapped_delta("a"))
    return _rounded(live.camera_offset(f).select("session_id", "seq", "cx", "cy", "speed", "turn"), "cx", "cy", "speed", "turn")


@query(f"WITH {_LIVE} SELECT event_id, round(conf * 0.4 + k * 0.35 + least(1, k * 5) * 0.2 + least(1, conf) * 0.05, 6) AS rank FROM l")
def feedback_rank(spark, sf_dir):
    return _live(spark, sf_dir).select("event_id", F.round(V.feedback_rank("conf", "k", "k", "conf"), 6).alias("rank"))


def live_detections(spark, sf_dir):
    """Events as one detection a frame: the box by value, the look by type."""
    kinds = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    at = F.array_position(kinds, F.col("event_type"))
    x = (F.col("k") % 10) / 12.0
    return frames(spark, sf_dir).select(
        F.col("session_id").cast("string").alias("session_id"), "seq", F.lit(0).alias("ord"), x.alias("x1"), (F.col("k") % 7 / 10.0).alias("y1"), (x + 0.15).alias("x2"), (F.col("k") % 7 / 10.0 + 0.2).alias("y2"),
        (F.col("value") / 100).alias("conf"), (F.col("value") > 8).alias("recognized"),
        F.when(at > 0, F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i == at, 1.0).otherwise(0.0))).alias("signature"),
    )


@query()
def live_tracker_replay(spark, sf_dir):
    return live.track_batch(live_detections(spark, sf_dir))


def feedback_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "purchase", "product").when(F.col("event_type") == "error", "hard_negative")
    # a time without a zone is that of UTC, whatever the session's zone is
    ts = F.concat(F.col("ts").cast("string"), F.lit("Z")) if e.schema["ts"].dataType == T.TimestampNTZType() else F.col("ts")
    us = F.unix_micros(ts.cast("timestamp"))
    s = (us - us % 1000) / 1000 / 1000  # parts of a millisecond go towards 1970, as in SQL
    value, hundreds = F.col("value"), F.col("value") * 100
    even = F.when(F.abs(hundreds) == float("inf"), value).otherwise(F.round(hundreds) / 100)  # of the product, as in SQL
    # SQL puts NaN above all numbers, also above infinity
    rank = F.when(F.isnan("value"), float("inf")).when(even == float("inf"), sys.float_info.max).otherwise(even)
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ident"), F.floor(s / 60).alias("at_ms"), rank.alias("rank"), label.alias("label"))


_FEEDBACK = folds.feedback_sql(live.FEEDBACK_MS, live.FEEDBACK_MOST, live.FEEDBACK_RECENT_MS)


@query(_FEEDBACK)
def feedback_replay(spark, sf_dir):
    return live.feedback_batch(feedback_events(spark, sf_dir))


@query("SELECT user_id AS job_id, arg_max(event_type, ts) AS sku_status, max(ts) AS ts FROM events GROUP BY 1")
def job_latest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("sku_status"), "ts")
    return live.job_states(e)


_PATHS = "p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'sku_exact_areas/' WHEN 1 THEN 'Store ' || page_id % 7 || '/' WHEN 2 THEN 'x/sku_uncertain_areas/' WHEN 3 THEN 'reports/' ELSE '' END || CASE page_id % 4 WHEN 0 THEN 'overview' WHEN 1 THEN 'zone_' ELSE 'IMG_' END || page_id || '.JPG' AS path FROM pages)"
_EV = f"""{_PATHS}, e AS (SELECT path, CASE WHEN contains(path, 'overview') THEN 'overview' WHEN contains(regexp_extract(path, '[^/]*$'), 'zone') THEN 'zone_crop' ELSE 'source_image' END AS role,
  CASE WHEN contains(path, 'sku_exact_areas/') THEN 'exact' WHEN contains(path, 'sku_uncertain_areas/') THEN 'uncertain' ELSE 'unknown' END AS zone_type,
  CASE WHEN starts_with(path, 'Store') OR starts_with(path, 'x/') THEN split_part(path, '/', 1) END AS store_name FROM p WHERE NOT starts_with(path, 'reports/')),
o AS (SELECT printf('obs_%06d', row_number() OVER (ORDER BY path)) AS observation_id, *, CASE WHEN role = 'overview' THEN 'not_product' WHEN zone_type = 'exact' THEN 'brand_only'
  WHEN zone_type = 'uncertain' THEN 'needs_retake' WHEN store_name IS NOT NULL THEN 'pending_analysis' ELSE 'unknown' END AS status,
  CASE WHEN role = 'overview' THEN 1.0 WHEN zone_type = 'exact' THEN 0.35 WHEN zone_type = 'uncertain' THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM e)"""


def _evidence(spark, sf_dir):
    k = F.col("page_id")
    top = (
        F.when(k % 5 == 0, "sku_exact_areas/").when(k % 5 == 1, F.concat(F.lit("Store "), (k % 7).cast("string"), F.lit("/"))).when(k % 5 == 2, "x/sku_uncertain_areas/").when(k % 5 == 3, "reports/").otherwise("")
    )
    stem = F.when(k % 4 == 0, "overview").when(k % 4 == 1, "zone_").otherwise("IMG_")
    return folder.evidence(table(spark, sf_dir, "pages").select(F.concat(top, stem, k.cast("string"), F.lit(".JPG")).alias("path")))


@query(f"WITH {_EV} SELECT observation_id, path, role, zone_type, store_name, status, confidence FROM o")
def observation_table(spark, sf_dir):
    return folder.observe(_evidence(spark, sf_dir)).drop("note")


@query(f"WITH {_EV} SELECT store_name, count(*) AS image_count FROM o WHERE store_name IS NOT NULL GROUP BY 1")
def store_summary(spark, sf_dir):
    return folder.store_summaries(_evidence(spark, sf_dir))


@query(
    f"""WITH {_EV} SELECT count(*) AS total_evidence_files, count(DISTINCT store_name) AS store_count, count(store_name) AS market_photo_files, count(*) FILTER (WHERE zone_type = 'exact') AS exact_zone_files,
  count(*) FILTER (WHERE zone_type = 'uncertain') AS uncertain_zone_files, count(*) FILTER (WHERE role = 'zone_crop') AS countable_zone_files, count(*) FILTER (WHERE role = 'overview') AS review_artifact_files,
  count(*) FILTER (WHERE status = 'brand_only') AS recognized_observations, count(*) FILTER (WHERE status = 'pending_analysis') AS pending_analysis_observations,
  count(*) FILTER (WHERE status = 'needs_retake') AS needs_review_observations, count(*) FILTER (WHERE status = 'unknown') AS unknown_observations FROM o"""
)
def audit_summary(spark, sf_dir):
    return folder.audit_summary(folder.observe(_evidence(spark, sf_dir)))


_QUALITY = """m AS (SELECT event_id, 800 + CAST(value * 10 AS INTEGER) AS width, 1000 AS height, k * 2.6 AS brightness, value AS contrast, k / 10.0 AS sharpness, CASE WHEN event_type = 'error' THEN 'video' ELSE 'image' END AS media_kind, 'S' || user_id % 9 AS store_name
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
s0 AS (SELECT *, least(width, height) < 900 AS low FROM m),
s AS (SELECT *, CASE WHEN sharpness < 5 THEN 'retake' WHEN brightness < 45 THEN 'retake' WHEN brightness > 225 OR low OR contrast < 22 THEN 'warning' ELSE 'ok' END AS quality_status,
  array_to_string(list_filter([CASE WHEN low THEN 'low_resolution' END, CASE WHEN brightness < 45 THEN 'too_dark' WHEN brightness > 225 THEN 'very_bright' END, CASE WHEN contrast < 22 THEN 'low_contrast' END,
    CASE WHEN sharpness < 5 THEN 'blurred' END], lambda x: x IS NOT NULL), ',') AS i FROM s0)"""


def _media(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    m = table(spark, sf_dir, "events").select(
        "event_id", (F.lit(800) + F.round(F.col("value") * 10).cast("int")).alias("width"), F.lit(1000).alias("height"), (k * 2.6).alias("brightness"), F.col("value").alias("contrast"), (k / 10.0).alias("sharpness"),
        F.when(F.col("event_type") == "error", "video").otherwise("image").alias("media_kind"), F.concat(F.lit("S"), (F.col("user_id") % 9).cast("string")).alias("store_name"),
    )
    state, issues = folder.quality_status()
    return m.withColumns({"quality_status": state, "issues": F.array_join(issues, ",")})


@query(f"WITH {_QUALITY} SELECT event_id, quality_status, CASE WHEN i = '' THEN 'acceptable' ELSE i END AS issues FROM s")
def quality_status(spark, sf_dir):
    return _media(spark, sf_dir).select("event_id", "quality_status", "issues")


@query(
    f"""WITH {_QUALITY} SELECT count(*) AS total, count(*) FILTER (WHERE media_kind = 'image') AS image, count(*) FILTER (WHERE media_kind = 'video') AS video, 0::BIGINT AS unsupported,
  count(*) FILTER (WHERE quality_status = 'ok') AS ok, 0::BIGINT AS pending, count(*) FILTER (WHERE quality_status = 'warning') AS warning, count(*) FILTER (WHERE quality_status = 'retake') AS retake,
  count(*) FILTER (WHERE quality_status IN ('ok', 'warning')) AS ready, string_agg(DISTINCT store_name, ',' ORDER BY store_name) AS stores FROM s"""
)
def media_summary(spark, sf_dir):
    return folder.media_summary(_media(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_ROOTS}, t AS (SELECT video, root, ord, (ord % 13) / CAST(13 AS DOUBLE) AS c FROM v JOIN roots ON node = ord),
o AS (SELECT video, root, arg_min(ord, struct_pack(a := -c, b := ord)) AS rep_track_id, max(c) AS peak_conf, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY c DESC, ord) AS track_ids FROM t GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY video ORDER BY root) AS INTEGER) AS object_id FROM o"""
)
def merged_objects(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    roots = graph.components(
        t.select(F.col("ord").alias("node")), vectorsearch.repass_edges(t, "video", 0.3, 12).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))
    )
    full = t.select("video", "ord", F.col("ord").alias("track_id"), ((F.col("ord") % 13) / 13.0).alias("peak_conf"))
    return tracks.merged_objects(full, roots, "video").withColumn("track_ids", F.array_join("track_ids", ","))
