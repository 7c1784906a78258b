"""Presence, totals, cross-video and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, evaluate, recognize, sequence, tracks
from ..sources import reports
from . import folds, views
from .registry import query, table

CONF = 0.75
_SURE = f"status = 'matched_sku' AND ocr_conf >= {CONF}"
_BEST = "arg_max({c}, struct_pack(a := ocr_conf, b := -ord))"


def _presence_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    best = ", ".join(f"{_BEST.format(c=c)} AS {n}" for c, n in (("crop", "best_crop"), ("method", "method")))
    first = ", ".join(f"arg_min({c}, ord) AS {c}" for c in ("sku_id", "article_codes", "brand", "model", "category", "is_own"))
    return f"""SELECT {k}coalesce(nullif(sku_id, ''), coalesce(brand, '') || '|' || coalesce(model, '')) AS sku_key, {first},
  count(*) AS evidence_objects, max(ocr_conf) AS best_ocr_conf, {best} FROM items WHERE {_SURE} GROUP BY {k}sku_key"""


@query(f"WITH {views.ITEMS_SQL}, p AS ({_presence_sql()}) SELECT * FROM p ORDER BY coalesce(brand, ''), coalesce(model, ''), coalesce(article_codes, '')")
def sku_presence(spark, sf_dir):
    return audit.sku_presence(views.items(spark, sf_dir), CONF, with_ids=False).orderBy(*audit.presence_order())


_PARTIAL = """SELECT {k}coalesce(brand, '') || '|' || coalesce(category, '') AS bc_key, arg_min(brand, ord) AS brand, arg_min(category, ord) AS category,
  arg_min(is_own, ord) AS is_own, count(*) AS evidence_objects, max(ocr_conf) AS best_ocr_conf,
  arg_max(crop, struct_pack(a := ocr_conf, b := -ord)) AS best_crop, arg_max(method, struct_pack(a := ocr_conf, b := -ord)) AS method
  FROM items WHERE status IN ('brand_only', 'category_only') GROUP BY {k}bc_key"""


@query(f"WITH {views.ITEMS_SQL} {_PARTIAL.format(k='')}")
def brand_category_presence(spark, sf_dir):
    return audit.brand_category_presence(views.items(spark, sf_dir)).orderBy(*audit.brand_category_order())


_TOTALS = f"""SELECT video, count(DISTINCT CASE WHEN {_SURE} THEN sku_id END) AS unique_skus, count(*) AS candidate_objects,
  count(*) FILTER (WHERE is_own) AS own_brand_objects, count(*) FILTER (WHERE NOT is_own) AS competitor_or_unknown,
  count(*) FILTER (WHERE {_SURE}) AS sku_evidence_objects, count(*) FILTER (WHERE NOT ({_SURE})) AS needs_review_objects,
  count(DISTINCT CASE WHEN status IN ('brand_only', 'category_only') THEN brand || '|' || category END) AS brand_category_partial,
  count(*) FILTER (WHERE status = 'unknown') AS brand_not_visible_objects,
  count(DISTINCT CASE WHEN {_SURE} AND is_own THEN sku_id END) AS unique_own_skus FROM items GROUP BY video"""
_TOTAL_NAMES = "*, candidate_objects AS physical_objects, unique_skus AS confident_sku, needs_review_objects AS needs_review, brand_not_visible_objects AS brand_not_visible"


@query(f"WITH {views.ITEMS_SQL}, t AS ({_TOTALS}) SELECT {_TOTAL_NAMES} FROM t")
def audit_totals(spark, sf_dir):
    return audit.totals(views.items(spark, sf_dir), CONF, ("video",))


def _top_sql(label: str) -> str:
    return f"WITH {views.ITEMS_SQL} SELECT {label} AS value, count(*) AS n, min(ord) AS first_ord FROM items GROUP BY 1"


@query(_top_sql("coalesce(nullif(brand, ''), '—')"))
def top_counts_brand(spark, sf_dir):
    return audit.most_common(views.items(spark, sf_dir), audit.brand_label())


@query(_top_sql("nullif(category, '')"))
def top_counts_category(spark, sf_dir):
    return audit.most_common(views.items(spark, sf_dir), X.falsy_null("category"))


@query(_top_sql("brand || ' ' || model || ' (' || article_codes || ')'"))
def top_counts_model(spark, sf_dir):
    return audit.most_common(views.items(spark, sf_dir), audit.label())


@query(
    f"""WITH {views.ITEMS_SQL}, p AS ({_presence_sql('video, video_ord')})
SELECT sku_key, arg_min(sku_id, video_ord) AS sku_id, arg_min(article_codes, video_ord) AS article_codes, arg_min(brand, video_ord) AS brand,
  arg_min(model, video_ord) AS model, arg_min(category, video_ord) AS category, arg_min(is_own, video_ord) AS is_own,
  CAST(sum(evidence_objects) AS BIGINT) AS evidence_objects, string_agg(video, ',' ORDER BY video_ord) AS videos, max(best_ocr_conf) AS best_ocr_conf,
  arg_max(best_crop, struct_pack(a := best_ocr_conf, b := -video_ord)) AS best_crop FROM p GROUP BY sku_key"""
)
def cross_video_aggregate(spark, sf_dir):
    per_video = audit.sku_presence(views.items(spark, sf_dir), CONF, ("video", "video_ord"), with_ids=False)
    return audit.merge_presence(per_video)


@query(
    f"""WITH {views.ITEMS_SQL}, t AS ({_TOTALS}), n AS (SELECT {_TOTAL_NAMES} FROM t),
u AS (UNPIVOT (SELECT * EXCLUDE (video) FROM n) ON COLUMNS(*) INTO NAME name VALUE v),
s AS (SELECT name, CAST(sum(v) AS BIGINT) AS s FROM u GROUP BY name),
p AS ({_presence_sql('video, video_ord')}), m AS (SELECT sku_key, arg_min(is_own, video_ord) AS is_own FROM p GROUP BY sku_key),
q AS ({_PARTIAL.format(k='')})
SELECT name, CASE WHEN name IN ('unique_skus', 'confident_sku') THEN (SELECT count(*) FROM m)
  WHEN name = 'unique_own_skus' THEN (SELECT count(*) FROM m WHERE is_own)
  WHEN name = 'brand_category_partial' THEN (SELECT count(*) FROM q) ELSE s END AS value FROM s"""
)
def cross_video_totals(spark, sf_dir):
    items = views.items(spark, sf_dir)
    merged = audit.merge_presence(audit.sku_presence(items, CONF, ("video", "video_ord"), with_ids=False))
    return audit.merge_totals(audit.totals(items, CONF, ("video",)), merged, audit.brand_category_presence(items))


_SETS = """
t AS (SELECT DISTINCT l_suppkey AS video, l_partkey AS sku FROM lineitem WHERE l_returnflag = 'A'),
p AS (SELECT DISTINCT l_suppkey AS video, l_partkey AS sku FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 10),
k AS (SELECT DISTINCT video FROM t),
b AS (SELECT k.video, count(t.sku) AS expected_skus, count(p.sku) AS predicted_skus, count(*) FILTER (WHERE t.sku IS NOT NULL AND p.sku IS NOT NULL) AS matched_skus,
  count(*) FILTER (WHERE t.sku IS NULL AND p.sku IS NOT NULL) AS extra_skus, count(*) FILTER (WHERE p.sku IS NULL AND t.sku IS NOT NULL) AS missing_skus
  FROM (t FULL JOIN p ON t.video = p.video AND t.sku = p.sku) JOIN k ON k.video = coalesce(t.video, p.video) GROUP BY k.video)"""
_RATES = """CASE WHEN matched_skus + extra_skus <> 0 THEN matched_skus / (matched_skus + extra_skus) WHEN expected_skus = 0 THEN 1.0 ELSE 0.0 END AS precision,
  CASE WHEN matched_skus + missing_skus <> 0 THEN matched_skus / (matched_skus + missing_skus) ELSE 1.0 END AS recall"""
_F1 = "CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END"


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _sets(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video"), F.col("l_partkey").alias("sku"), "l_returnflag", "l_linestatus", "l_quantity")
    return line.where("l_returnflag = 'A'"), line.where("l_linestatus = 'F' AND l_quantity > 10")


@query(f"WITH {_SETS}, r AS (SELECT *, {_RATES} FROM b) SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall), round({_F1}, 6) AS f1 FROM r")
def coverage_metrics(spark, sf_dir):
    return _rounded(evaluate.coverage(*_sets(spark, sf_dir)), "precision", "recall", "f1")


@query(
    f"""WITH {_SETS}, m AS (SELECT CAST(sum(expected_skus) AS BIGINT) AS expected_skus, CAST(sum(predicted_skus) AS BIGINT) AS predicted_skus,
  CAST(sum(matched_skus) AS BIGINT) AS matched_skus, CAST(sum(extra_skus) AS BIGINT) AS extra_skus, CAST(sum(missing_skus) AS BIGINT) AS missing_skus FROM b),
r AS (SELECT *, {_RATES} FROM m) SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall), round({_F1}, 6) AS f1 FROM r"""
)
def coverage_micro(spark, sf_dir):
    return _rounded(evaluate.coverage_micro(evaluate.coverage(*_sets(spark, sf_dir))), "precision", "recall", "f1")


@query(
    f"""WITH {_SETS}, d AS (SELECT t.video, t.sku, 'missing' AS kind FROM t ANTI JOIN p ON t.video = p.video AND t.sku = p.sku
  UNION ALL SELECT p.video, p.sku, 'extra' FROM p ANTI JOIN t ON t.video = p.video AND t.sku = p.sku)
SELECT video, coalesce(string_agg(sku, ',' ORDER BY sku) FILTER (WHERE kind = 'missing'), '') AS missing_ids,
  coalesce(string_agg(sku, ',' ORDER BY sku) FILTER (WHERE kind = 'extra'), '') AS extra_ids FROM d GROUP BY video"""
)
def coverage_differences(spark, sf_dir):
    return evaluate.set_differences(*_sets(spark, sf_dir))


_COUNTS = """
t AS (SELECT o_orderkey AS video, CAST(floor(o_totalprice / 100000) AS BIGINT) AS true_objects FROM orders),
r AS (SELECT l_orderkey AS video, count(*) AS predicted_objects FROM lineitem GROUP BY 1),
e AS (SELECT video, true_objects, predicted_objects, predicted_objects - true_objects AS delta,
  CASE WHEN true_objects <> 0 THEN abs(predicted_objects - true_objects) / true_objects ELSE CAST(predicted_objects > 0 AS DOUBLE) END AS count_error FROM t JOIN r USING (video))"""


def _counts(spark, sf_dir):
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), F.floor(F.col("o_totalprice") / 100000).alias("true_objects"))
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.count(F.lit(1)).alias("predicted_objects"))
    return truth, seen


@query(f"WITH {_COUNTS} SELECT * REPLACE (round(count_error, 6) AS count_error) FROM e")
def count_error(spark, sf_dir):
    return _rounded(evaluate.count_errors(*_counts(spark, sf_dir)), "count_error")


@query(
    f"""WITH {_COUNTS} SELECT count(*) AS videos, CAST(sum(true_objects) AS BIGINT) AS true_objects, CAST(sum(predicted_objects) AS BIGINT) AS predicted_objects,
  round(avg(count_error), 6) AS mean_video_count_error, CAST(sum(predicted_objects) - sum(true_objects) AS BIGINT) AS delta,
  round(abs(CAST(sum(predicted_objects) - sum(true_objects) AS DOUBLE)) / sum(true_objects), 6) AS count_error FROM e"""
)
def count_summary(spark, sf_dir):
    return _rounded(evaluate.count_summary(evaluate.count_errors(*_counts(spark, sf_dir))), "count_error", "mean_video_count_error")


@query(f"WITH {_COUNTS} SELECT t.video FROM t ANTI JOIN r USING (video)")
def missing_reports(spark, sf_dir):
    return evaluate.missing_reports(*_counts(spark, sf_dir))


_CONFIGS = "SELECT unnest([4, 1, 2, 3]) AS c, unnest([0, 5, 20, 35]) AS q"


@query(
    f"""WITH {_SETS.split('p AS')[0]} g AS ({_CONFIGS}),
p AS (SELECT DISTINCT c, l_suppkey AS video, l_partkey AS sku FROM lineitem, g WHERE l_linestatus = 'F' AND l_quantity > q),
tc AS (SELECT c, video, sku FROM t, g),
k AS (SELECT DISTINCT c, video FROM tc),
b AS (SELECT k.c, k.video, count(t.sku) AS expected_skus, count(p.sku) AS predicted_skus, count(*) FILTER (WHERE t.sku IS NOT NULL AND p.sku IS NOT NULL) AS matched_skus,
  count(*) FILTER (WHERE t.sku IS NULL AND p.sku IS NOT NULL) AS extra_skus, count(*) FILTER (WHERE p.sku IS NULL AND t.sku IS NOT NULL) AS missing_skus
  FROM (tc t FULL JOIN p ON t.c = p.c AND t.video = p.video AND t.sku = p.sku) JOIN k ON k.c = coalesce(t.c, p.c) AND k.video = coalesce(t.video, p.video) GROUP BY 1, 2),
m AS (SELECT c, sum(expected_skus) AS expected_skus, sum(matched_skus) AS matched_skus, sum(extra_skus) AS extra_skus, sum(missing_skus) AS missing_skus FROM b GROUP BY c),
r AS (SELECT c, {_RATES} FROM m), f AS (SELECT *, {_F1} AS f1 FROM r)
SELECT CAST(c AS INTEGER) AS config, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round((SELECT f1 FROM f WHERE c = 1), 6) AS baseline_f1, round(f1 - (SELECT f1 FROM f WHERE c = 1), 6) AS f1_delta
FROM f ORDER BY f1 DESC, recall DESC, c LIMIT 1"""
)
def best_config(spark, sf_dir):
    """A sweep of four thresholds, each scored over all videos, and the best against the first."""
    truth, _ = _sets(spark, sf_dir)
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(q).alias("q")) for c, q in ((4, 0), (1, 5), (2, 20), (3, 35))])).alias("g")
    line = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    pred = line.select("l_quantity", F.col("l_suppkey").alias("v"), F.col("l_partkey").alias("sku"), grid).where("l_quantity > g.q").select(F.struct("g.c", "v").alias("video"), "sku")
    t = truth.select(F.col("video").alias("v"), "sku", grid).select(F.struct("g.c", "v").alias("video"), "sku")
    rows = evaluate.coverage(t, pred).withColumn("config", F.col("video.c"))
    scored = evaluate.coverage_micro(rows, ("config",)).select("config", "precision", "recall", "f1", F.col("config").alias("ord"), (F.col("config") == 1).alias("baseline"))
    best = evaluate.best_config(scored).select("config", "precision", "recall", "f1", "baseline_f1", "f1_delta")
    return _rounded(best, "precision", "recall", "f1", "baseline_f1", "f1_delta")


def boxes(spark, sf_dir):
    """Line items as boxes of an image, its order."""
    line = table(spark, sf_dir, "lineitem")
    x1, y1 = F.col("l_quantity") * 10, F.col("l_linenumber") * 70.0
    return line.select(
        F.col("l_orderkey").alias("image_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 40 + F.col("l_tax") * 2000).alias("x2"),
        (y1 + 30 + F.col("l_discount") * 1500).alias("y2"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "A").alias("is_truth"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("cls"),
    )


BOXES_SQL = """
boxes AS (SELECT l_orderkey AS image_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, l_quantity * 10 AS x1, l_linenumber * CAST(70.0 AS DOUBLE) AS y1,
  l_quantity * 10 + 40 + l_tax * 2000 AS x2, l_linenumber * CAST(70.0 AS DOUBLE) + 30 + l_discount * 1500 AS y2, l_extendedprice AS score,
  l_returnflag = 'A' AS is_truth, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS cls FROM lineitem)"""


@query(f"WITH RECURSIVE {folds.matches_sql(BOXES_SQL, 0.3)} SELECT * FROM m")
def detector_match(spark, sf_dir):
    return sequence.match_counts(boxes(spark, sf_dir), "image_id", 0.3)


@query(
    f"""WITH RECURSIVE {folds.matches_sql(BOXES_SQL, 0.3)},
s AS (SELECT count(*) AS images, CAST(sum(gt) AS BIGINT) AS gt, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  avg(CASE WHEN gt > 0 THEN abs(pred - gt) / gt WHEN pred > 0 THEN 1 ELSE 0 END) AS e FROM m)
SELECT images, gt, pred, tp, fp, fn, round(e, 6) AS mean_image_count_error, round(CASE WHEN gt > 0 THEN abs(pred - gt) / gt WHEN pred > 0 THEN 1 ELSE 0 END, 6) AS count_error,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM s"""
)
def detector_summary(spark, sf_dir):
    return _rounded(evaluate.detector_summary(sequence.match_counts(boxes(spark, sf_dir), "image_id", 0.3)), "mean_image_count_error", "count_error", "precision", "recall")


def _reads(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("object_id"),
        (F.col("l_partkey") % 7).cast("string").alias("sku_id"),
        F.round(F.col("l_quantity") / 50, 4).alias("score"),
        ((F.col("l_linenumber") * 1000000) + F.col("l_partkey")).alias("ord"),
    )


_READS = "reads AS (SELECT l_orderkey AS object_id, CAST(l_partkey % 7 AS VARCHAR) AS sku_id, round(l_quantity / 50, 4) AS score, l_linenumber * 1000000 + l_partkey AS ord FROM lineitem)"


@query(
    f"""WITH {_READS}, v AS (SELECT object_id, sku_id, count(*) AS votes, max(score) AS score, min(ord) AS ord FROM reads GROUP BY 1, 2)
SELECT object_id, sku_id, votes, score FROM v QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY votes DESC, score DESC, ord) = 1"""
)
def vote_winner(spark, sf_dir):
    return recognize.vote_winner(_reads(spark, sf_dir), ["object_id"])


@query(
    """WITH r AS (SELECT l_suppkey AS video, (l_partkey % 4) * 90 AS rotation, l_extendedprice AS peak_conf, l_returnflag = 'R' AS unknown,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY peak_conf DESC, ord) AS n FROM r),
c AS (SELECT video, rotation, count(*) AS votes, min(n) AS f FROM n WHERE n <= 8 AND NOT unknown GROUP BY 1, 2),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY video ORDER BY votes DESC, f) = 1)
SELECT video, rotation, votes FROM b WHERE votes >= 2"""
)
def rotation_mode(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("video"),
        ((F.col("l_partkey") % 4) * 90).alias("rotation"),
        F.col("l_extendedprice").alias("peak_conf"),
        F.when(F.col("l_returnflag") == "R", "unknown").otherwise("matched_sku").alias("status"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"),
    )
    return recognize.rotation_mode(line, ["video"])


_FRAMES = "frames AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, value, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def frames(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), n.cast("long").alias("seq"), "event_id", "value", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")
    )


@query(
    f"""WITH {_FRAMES}, c AS (SELECT *, min(CASE WHEN value >= 60 THEN seq END) OVER (PARTITION BY session_id) AS cut FROM frames),
u AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_read FROM c WHERE cut IS NULL OR seq <= cut)
SELECT session_id, seq, event_id, value, event_type, k, n_read FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY value DESC, seq) = 1"""
)
def first_stop_best(spark, sf_dir):
    return recognize.first_stop_best(frames(spark, sf_dir), ["session_id"], F.col("value") >= 60, "seq", "value")


_DETS = """d AS (SELECT user_id AS video, CAST(json_extract(props, '$.k') AS BIGINT) % 20 AS track_id, event_id AS frame, round(value / 100, 4) AS conf, value * 2 AS quality FROM events)"""


def _detections(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"), (k % 20).alias("track_id"), F.col("event_id").alias("frame"), F.round(F.col("value") / 100, 4).alias("conf"), (F.col("value") * 2).alias("quality")
    )


@query(
    f"""WITH {_DETS} SELECT video, track_id, count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame, max(conf) AS peak_conf,
  arg_min(frame, struct_pack(a := -quality, b := frame)) AS best_frame FROM d GROUP BY 1, 2 HAVING count(*) >= 3 AND max(conf) >= 0.35"""
)
def track_aggregate(spark, sf_dir):
    return tracks.track_aggregate(_detections(spark, sf_dir), ["video", "track_id"])


@query(f"WITH {_DETS} SELECT *, CAST(row_number() OVER (PARTITION BY video ORDER BY quality DESC, frame) AS INTEGER) AS rank FROM d QUALIFY rank <= 5")
def top_crops(spark, sf_dir):
    return tracks.top_crops(_detections(spark, sf_dir), ["video"], 5)


@query(
    f"""WITH {views.ITEMS_SQL}, t AS ({_TOTALS}), r AS (SELECT video, CAST(unique_skus AS BIGINT) AS unique_skus, candidate_objects, 0 AS is_total FROM t)
SELECT * FROM r UNION ALL SELECT 'TOTAL', CAST(sum(unique_skus) AS BIGINT), CAST(sum(candidate_objects) AS BIGINT), 1 FROM r"""
)
def summary_with_total(spark, sf_dir):
    return reports.with_total(audit.totals(views.items(spark, sf_dir), CONF, ("video",)), "video", ["unique_skus", "candidate_objects"])


def _table_sql(rows: str, columns: dict[str, str], order: str, title: str, section: int) -> str:
    line = "'| ' || " + " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + " || ' |'"
    head = "| " + " | ".join(columns.values()) + " |"
    fixed = [(-5, ""), (-4, f"## {title}"), (-3, "")]
    arms = [f"SELECT {section}, {p}, '{t}'" for p, t in fixed]
    arms += [f"SELECT {section}, {p}, '{t}' WHERE EXISTS (SELECT 1 FROM {rows})" for p, t in ((-2, head), (-1, "|" + "---|" * len(columns)))]
    arms += [f"SELECT {section}, 0, 'None.' WHERE NOT EXISTS (SELECT 1 FROM {rows})", f"SELECT {section}, row_number() OVER (ORDER BY {order}, {line}), {line} FROM {rows}"]
    return " UNION ALL ".join(arms)


_REPORT = f"""WITH {views.ITEMS_SQL}, p AS ({_presence_sql()}), b AS ({_PARTIAL.format(k='')}),
l(section, place, line) AS (
  SELECT 0, -4, '# Audit' UNION ALL SELECT 1, -5, '' UNION ALL SELECT 1, -4, '## Totals' UNION ALL SELECT 1, -3, ''
  UNION ALL SELECT 1, 1, '- unique_skus: ' || count(*) FROM p UNION ALL SELECT 1, 2, '- unique_own_skus: ' || count(*) FILTER (WHERE is_own) FROM p
  UNION ALL SELECT 1, 3, '- candidate_objects: ' || count(*) FROM items
  UNION ALL {_table_sql('p', {"brand": "Brand", "model": "Model", "article_codes": "Article", "evidence_objects": "Objects"}, "coalesce(brand, ''), coalesce(model, ''), coalesce(article_codes, '')", "Products", 2)}
  UNION ALL {_table_sql('b', {"brand": "Brand", "category": "Category", "evidence_objects": "Objects"}, "coalesce(brand, ''), coalesce(category, '')", "Partly read", 3)})
SELECT CAST(section AS INTEGER) AS section, CAST(place AS BIGINT) AS place, line FROM l"""


@query(_REPORT)
def audit_report(spark, sf_dir):
    """The whole report of the flagship audit, line by line."""
    items = views.items(spark, sf_dir)
    presence = audit.sku_presence(items, CONF, with_ids=False)
    partial = audit.brand_category_presence(items)
    return reports.document(
        "Audit",
        [
            reports.totals_lines(audit.totals(items, CONF), ["unique_skus", "unique_own_skus", "candidate_objects"], "Totals"),
            reports.markdown_table(
                presence, {"brand": "Brand", "model": "Model", "article_codes": "Article", "evidence_objects": "Objects"}, audit.presence_order(), "Products"
            ),
            reports.markdown_table(partial, {"brand": "Brand", "category": "Category", "evidence_objects": "Objects"}, [X.or_empty("brand"), X.or_empty("category")], "Partly read"),
        ],
    )
