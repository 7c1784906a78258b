"""SQL of greedy operators: a group's rows are folded in order by a recursive query
whose state is the list of rows kept so far."""

from __future__ import annotations

BOX_ROW = "{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score, 'cls': cls, 'mark': is_truth}"


def both(a: str, b: str) -> str:
    """Area that two boxes share."""
    return f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0)"


def area(a: str) -> str:
    return f"greatest({a}.x2 - {a}.x1, 0.0) * greatest({a}.y2 - {a}.y1, 0.0)"


def iou(a: str, b: str, eps: str = "") -> str:
    union = f"({area(a)} + {area(b)} - {both(a, b)})"
    return f"({both(a, b)} / ({union} + {eps}))" if eps else f"coalesce({both(a, b)} / nullif({union}, 0), 0)"


def kept(name: str, rows: str, order: str, conflict: str, start: str | None = None) -> str:
    """CTE ``name`` (``image_id``, ``r``): rows kept of the CTE ``rows`` in order; one
    goes if ``conflict`` (of a kept ``k`` and the row ``n.r``) holds with some kept row.
    ``start``, a CTE with ``image_id`` and a list ``l``, is kept from the first."""
    begin = f"SELECT image_id, CAST(0 AS BIGINT) AS i, l AS kept FROM {start}" if start else f"SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS i, list_filter([r], lambda x: false) AS kept FROM {name}_n"
    return f"""{name}_n AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS n, {BOX_ROW} AS r FROM {rows}),
{name}_f AS ({begin}
  UNION ALL SELECT f.image_id, f.i + 1, CASE WHEN len(list_filter(f.kept, lambda k: {conflict})) > 0 THEN f.kept ELSE list_append(f.kept, n.r) END
  FROM {name}_f f JOIN {name}_n n ON n.image_id = f.image_id AND n.n = f.i + 1),
{name}_l AS (SELECT image_id, arg_max(kept, i) AS l FROM {name}_f GROUP BY 1),
{name} AS (SELECT image_id, unnest(l) AS r FROM {name}_l)"""


KEPT_COLUMNS = "image_id, r.ord AS ord, r.x1 AS x1, r.y1 AS y1, r.x2 AS x2, r.y2 AS y2, r.score AS score"


def nms_sql(boxes: str, threshold: float) -> str:
    return f"WITH RECURSIVE {boxes}, {kept('s', 'boxes', 'score DESC, ord', iou('k', 'n.r') + f' >= {threshold}')} SELECT {KEPT_COLUMNS} FROM s"


def contain_sql(boxes: str, contain: float = 0.8, overlap: float = 0.7) -> str:
    b = both("k", "n.r")
    rule = f"{b} > 0 AND ({b} / ({area('n.r')} + 1e-6) > {contain} OR {b} / ({area('k')} + {area('n.r')} - {b} + 1e-6) > {overlap})"
    return f"WITH RECURSIVE {boxes}, {kept('s', 'boxes', '(x2 - x1) * (y2 - y1) DESC, ord', rule)} SELECT {KEPT_COLUMNS} FROM s"


def package_sql(boxes: str, package: str, loose: str, nested: str) -> str:
    """Packages kept, loose boxes that stand in none of them kept, both together kept."""
    plain = "image_id, r.ord AS ord, r.x1 AS x1, r.y1 AS y1, r.x2 AS x2, r.y2 AS y2, r.score AS score, r.cls AS cls, r.mark AS is_truth"
    return f"""WITH RECURSIVE {boxes},
pb AS (SELECT * FROM boxes WHERE is_truth AND {package}),
{kept('p', 'pb', 'score DESC, ord', iou('k', 'n.r') + ' >= 0.65')},
packages AS (SELECT {plain} FROM p),
free AS (SELECT * FROM boxes i WHERE NOT is_truth AND {loose} AND NOT EXISTS (SELECT 1 FROM packages o WHERE o.image_id = i.image_id AND {nested})),
{kept('u', 'free', 'score DESC, ord', iou('k', 'n.r') + ' >= 0.55')},
united AS (SELECT * FROM packages UNION ALL SELECT {plain} FROM u),
{kept('s', 'united', 'score DESC, ord', iou('k', 'n.r') + ' >= 0.75')}
SELECT {KEPT_COLUMNS} FROM s"""


def anchors_sql(boxes: str) -> str:
    """Labels stand from the first; anchors stay where they overlap nothing kept."""
    start = f"first AS (SELECT image_id, coalesce(list({BOX_ROW} ORDER BY ord) FILTER (WHERE is_truth), []) AS l FROM boxes GROUP BY 1), anchors AS (SELECT * FROM boxes WHERE NOT is_truth)"
    return f"""WITH RECURSIVE {boxes}, {start}, {kept('s', 'anchors', 'ord', iou('k', 'n.r') + ' > 0.35', 'first')}
SELECT image_id, r.ord AS ord FROM s WHERE NOT r.mark"""


def override_sql(boxes: str) -> str:
    """Entries in order: one like a label of its class is skipped, else labels of other classes under it go."""
    over = iou("k", "n.r")
    return f"""WITH RECURSIVE {boxes},
n AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS n, {BOX_ROW} AS r FROM boxes WHERE is_truth),
f AS (SELECT image_id, CAST(0 AS BIGINT) AS i, coalesce(list({BOX_ROW} ORDER BY ord) FILTER (WHERE NOT is_truth), []) AS kept FROM boxes GROUP BY 1
  UNION ALL SELECT f.image_id, f.i + 1, CASE WHEN len(list_filter(f.kept, lambda k: k.cls = n.r.cls AND {over} > 0.65)) > 0 THEN f.kept
    ELSE list_append(list_filter(f.kept, lambda k: k.cls = n.r.cls OR {over} <= 0.35), n.r) END
  FROM f JOIN n ON n.image_id = f.image_id AND n.n = f.i + 1),
l AS (SELECT image_id, unnest(arg_max(kept, i)) AS r FROM f GROUP BY 1)
SELECT image_id, r.ord AS ord, r.cls AS cls, r.mark AS manual FROM l"""


def matches_sql(boxes: str, threshold: float) -> str:
    """CTEs up to ``m`` (``image_id gt pred tp fp fn``): pairs taken by overlap, each box once."""
    return f"""{boxes},
c AS (SELECT image_id, count(*) FILTER (WHERE is_truth) AS gt, count(*) FILTER (WHERE NOT is_truth) AS pred FROM boxes GROUP BY 1),
pairs AS (SELECT p.image_id, p.ord AS p, g.ord AS g, {iou('p', 'g', '1e-6')} AS o FROM boxes p JOIN boxes g ON p.image_id = g.image_id AND NOT p.is_truth AND g.is_truth),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY o DESC, p, g) AS n FROM pairs WHERE o >= {threshold}),
f AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS i, [p][2:] AS ps, [g][2:] AS gs FROM n
  UNION ALL SELECT f.image_id, f.i + 1, CASE WHEN list_contains(f.ps, n.p) OR list_contains(f.gs, n.g) THEN f.ps ELSE list_append(f.ps, n.p) END,
    CASE WHEN list_contains(f.ps, n.p) OR list_contains(f.gs, n.g) THEN f.gs ELSE list_append(f.gs, n.g) END
  FROM f JOIN n ON n.image_id = f.image_id AND n.n = f.i + 1),
t AS (SELECT image_id, max(len(ps)) AS tp FROM f GROUP BY 1),
m AS (SELECT image_id, gt, pred, coalesce(tp, 0) AS tp, pred - coalesce(tp, 0) AS fp, gt - coalesce(tp, 0) AS fn FROM c LEFT JOIN t USING (image_id))"""


def changed_sql(frames: str, least: float) -> str:
    """Frames that differ from the last kept one; the state is that frame."""
    return f"""WITH RECURSIVE {frames},
f AS (SELECT session_id, seq, value, CAST(k AS DOUBLE) AS k, true AS kept FROM frames WHERE seq = 1
  UNION ALL SELECT n.session_id, n.seq,
    CASE WHEN (abs(n.value - f.value) + abs(n.k - f.k)) / 2 >= {least} THEN n.value ELSE f.value END,
    CASE WHEN (abs(n.value - f.value) + abs(n.k - f.k)) / 2 >= {least} THEN CAST(n.k AS DOUBLE) ELSE f.k END,
    (abs(n.value - f.value) + abs(n.k - f.k)) / 2 >= {least}
  FROM f JOIN frames n ON n.session_id = f.session_id AND n.seq = f.seq + 1)
SELECT session_id, seq FROM f WHERE kept"""


def feedback_sql(keep_ms: int, most: int, recent_ms: int) -> str:
    """Candidates in a buffer by age and number; a click takes the best of the recent ones and empties it."""
    return f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS ident, CAST(floor((epoch_ms(ts) / 1000) / 60) AS BIGINT) AS at_ms, round(value, 2) AS rank,
  CASE event_type WHEN 'purchase' THEN 'product' WHEN 'error' THEN 'hard_negative' END AS label FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, ident) AS n FROM e),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS i, list_filter([{{'ident': ident, 'at': at_ms, 'rank': rank}}], lambda x: false) AS buf, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS at_ms,
    CAST(NULL AS STRUCT(ident BIGINT, "at" BIGINT, rank DOUBLE)) AS best FROM n WHERE n = 1
  UNION ALL SELECT f.session_id, f.i + 1,
    CASE WHEN n.label IS NULL THEN list_append(list_filter(f.buf, lambda r: n.at_ms - r.at <= {keep_ms}), {{'ident': n.ident, 'at': n.at_ms, 'rank': n.rank}})[-{most}:]
      ELSE list_filter(f.buf, lambda r: false) END,
    n.label, n.at_ms,
    CASE WHEN n.label IS NOT NULL AND len(list_filter(f.buf, lambda r: n.at_ms - r.at <= {keep_ms})) > 0
      THEN list_reduce(list_filter(f.buf, lambda r: f.buf[-1].at - r.at <= {recent_ms} AND n.at_ms - r.at <= {keep_ms}), lambda a, b: CASE WHEN b.rank > a.rank THEN b ELSE a END) END
  FROM f JOIN n ON n.session_id = f.session_id AND n.n = f.i + 1)
SELECT session_id, label, at_ms, best.ident AS candidate, best.at AS candidate_ms FROM f WHERE best IS NOT NULL"""
