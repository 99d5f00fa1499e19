"""SQL of the box questions for DuckDB."""

from __future__ import annotations

from quillon.plans.scene_sql import BOXES

_MORE = """,
cnt AS (SELECT d.*, cc.n AS n_class, (x2 - x1) * (y2 - y1) AS area, w, h FROM d JOIN cc USING (image_id, label) JOIN img USING (image_id)),
one AS (SELECT c.* FROM cnt c JOIN gate USING (image_id) WHERE n_class = 1),
kinds AS (SELECT image_id, count(*) AS k FROM cc GROUP BY 1),
apart AS (SELECT DISTINCT a.image_id FROM d a JOIN d b ON b.image_id = a.image_id AND a.det_idx < b.det_idx AND a.label <> b.label
          WHERE least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1)),
dep AS (SELECT image_id, det_idx, label, x1, y1, x2, y2, 10.0 * img_h / greatest(y2, 1.0) AS z FROM d),
zp AS (SELECT a.image_id, a.label AS l1, b.label AS l2, a.z AS z1, b.z AS z2,
              (least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1)) AND abs(a.z - b.z) >= 0.1 * least(a.z, b.z) AS sure
       FROM dep a JOIN dep b ON b.image_id = a.image_id AND a.label <> b.label WHERE a.image_id IN (SELECT image_id FROM apart))
"""
_SHAPE = "CASE WHEN abs((x2 - x1) / greatest(y2 - y1, 1e-6) - 1) >= 0.75 THEN CASE WHEN (x2 - x1) / greatest(y2 - y1, 1e-6) > 1 THEN 'Yes' ELSE 'No' END END"


def _q(body: str) -> str:
    return BOXES + _MORE + f"SELECT image_id, CAST(subject AS VARCHAR) AS subject, CAST(answer AS VARCHAR) AS answer FROM ({body}) WHERE answer IS NOT NULL"


def _edge(source: str, left: bool) -> str:
    order, lead = ("x1, det_idx", "x1") if left else ("x2 DESC, det_idx", "x2")
    half = "x1 < w / 2.0 AND x2 < w / 2.0" if left else "x1 > w / 2.0 AND x2 > w / 2.0"
    gap = "nx - x2 >= 0.05 * w" if left else "x1 - nx >= 0.05 * w"
    return f"SELECT *, {half} AS half, nx IS NULL OR {gap} AS free FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS k, lead({lead}) OVER (PARTITION BY image_id ORDER BY {order}) AS nx FROM {source})"


def _top(values: str, order: str, keep: str) -> str:
    return f"""SELECT image_id, '3' AS subject, string_agg(label, ', ' ORDER BY k) AS answer FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}, fs) AS k, lead(v) OVER (PARTITION BY image_id ORDER BY {order}, fs) AS nv FROM ({values})) WHERE k <= 3
  GROUP BY 1 HAVING count(*) = 3 AND bool_and(k = 3 OR {keep})"""


def _beside(yes: str) -> str:
    ext = "(SELECT image_id, label, min(x2) AS lo2, max(x1) AS hi1 FROM d GROUP BY 1, 2)"
    return f"SELECT a.image_id, a.label || '/' || b.label AS subject, CASE WHEN {yes} THEN 'Yes' ELSE 'No' END AS answer FROM {ext} a JOIN {ext} b ON b.image_id = a.image_id AND a.label <> b.label WHERE a.image_id IN (SELECT image_id FROM apart)"


_IN_GATE = "(SELECT c.* FROM cnt c JOIN gate USING (image_id))"
_LOW = "greatest(0, CAST(floor((CASE WHEN v > 0.05 THEN 0.4 ELSE 0.5 END) * n - 1e-6) AS BIGINT))"
_MID = "CAST(floor((CASE WHEN v > 0.05 THEN 1.8 ELSE 1.5 END) * n) AS BIGINT)"

SQL: dict[str, str] = {
    "how_many": _q("SELECT image_id, label AS subject, n AS answer FROM cc"),
    "thirds": _q("""SELECT image_id, label AS subject, CASE
  WHEN abs(x1 - w / 3.0) < 0.05 * w OR abs(x2 - w / 3.0) < 0.05 * w OR abs(x1 - 2 * w / 3.0) < 0.05 * w OR abs(x2 - 2 * w / 3.0) < 0.05 * w THEN NULL
  WHEN x2 < w / 3.0 - 0.05 * w THEN 'A' WHEN x1 > w / 3.0 + 0.05 * w AND x2 < 2 * w / 3.0 - 0.05 * w THEN 'B' WHEN x1 > 2 * w / 3.0 + 0.05 * w THEN 'C' END AS answer FROM one"""),
    "width_vs_height": _q(f"SELECT image_id, label AS subject, {_SHAPE} AS answer FROM one"),
    "quadrants": _q("""SELECT image_id, label AS subject, CAST(r * 3 + c + 1 AS BIGINT) AS answer FROM (SELECT *, w / 3.0 AS qw, h / 3.0 AS qh, floor(y1 / (h / 3.0)) AS r, floor(x1 / (w / 3.0)) AS c FROM one)
  WHERE r = floor(y2 / qh) AND c = floor(x2 / qw) AND x1 >= c * qw + 0.1 * qw AND x2 <= (c + 1) * qw - 0.1 * qw AND y1 >= r * qh + 0.1 * qh AND y2 <= (r + 1) * qh - 0.1 * qh"""),
    "largest": _q("""SELECT image_id, '' AS subject, label AS answer FROM (SELECT *, row_number() OVER w2 AS k, lead(area) OVER w2 AS na FROM cnt WHERE image_id IN (SELECT image_id FROM kinds WHERE k >= 2)
  WINDOW w2 AS (PARTITION BY image_id ORDER BY area DESC, det_idx)) WHERE k = 1 AND area > 1.3 * na"""),
    "rank_largest_k": _q(_top("SELECT image_id, label, max(area) AS v, min(det_idx) AS fs FROM cnt GROUP BY 1, 2", "v DESC", "v >= 1.3 * nv")),
    "most": _q("SELECT image_id, '' AS subject, label AS answer FROM (SELECT *, row_number() OVER w2 AS k, lead(n) OVER w2 AS nn FROM cc WINDOW w2 AS (PARTITION BY image_id ORDER BY n DESC, first_seen)) WHERE k = 1 AND n >= 1.2 * nn"),
    "least": _q("SELECT image_id, '' AS subject, label AS answer FROM (SELECT *, row_number() OVER w2 AS k, lead(n) OVER w2 AS nn FROM cc WINDOW w2 AS (PARTITION BY image_id ORDER BY n, first_seen)) WHERE k = 1 AND nn >= 1.2 * n"),
    "left_of": _q(_beside("a.lo2 < b.hi1")),
    "right_of": _q(_beside("a.hi1 > b.lo2")),
    "leftmost": _q(f"SELECT image_id, '' AS subject, label AS answer FROM ({_edge(_IN_GATE, True)}) WHERE k = 1 AND half AND free"),
    "rightmost": _q(f"SELECT image_id, '' AS subject, label AS answer FROM ({_edge(_IN_GATE, False)}) WHERE k = 1 AND half AND free"),
    "leftmost_wh": _q(f"SELECT image_id, '' AS subject, {_SHAPE} AS answer FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k) AS f FROM ({_edge('one', True)}) WHERE half AND free) WHERE f = 1"),
    "rightmost_wh": _q(f"SELECT image_id, '' AS subject, {_SHAPE} AS answer FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k) AS f FROM ({_edge('one', False)}) WHERE half AND free) WHERE f = 1"),
    "are_more": _q("SELECT a.image_id, a.label || '/' || b.label AS subject, CASE WHEN a.n > b.n AND a.n >= 1.2 * b.n THEN 'Yes' WHEN b.n > a.n AND b.n >= 1.2 * a.n THEN 'No' END AS answer FROM cc a JOIN cc b ON b.image_id = a.image_id AND a.first_seen < b.first_seen"),
    "which_more": _q("""SELECT image_id, subject, win || 's' AS answer FROM (SELECT a.image_id, a.label || '/' || b.label || '/' || c.label AS subject, list_reverse_sort([a.n, b.n, c.n]) AS r,
  CASE WHEN a.n >= b.n AND a.n >= c.n THEN a.label WHEN b.n >= c.n THEN b.label ELSE c.label END AS win
  FROM cc a JOIN cc b ON b.image_id = a.image_id AND a.first_seen < b.first_seen JOIN cc c ON c.image_id = a.image_id AND b.first_seen < c.first_seen) WHERE r[1] > r[2] AND r[1] >= 1.2 * r[2]"""),
    "more_than": _q("""SELECT image_id, label || '/' || CASE WHEN greatest(1, n // 2) = n THEN greatest(1, n - 1) ELSE greatest(1, n // 2) END AS subject, 'Yes' AS answer FROM cc
  UNION ALL SELECT image_id, label || '/' || (n * 2), 'No' FROM cc"""),
    "less_than": _q("""SELECT image_id, label || '/' || (n * 2) AS subject, 'Yes' AS answer FROM cc
  UNION ALL SELECT image_id, label || '/' || CASE WHEN t = 1 THEN 0 ELSE t END, CASE WHEN t = 1 THEN 'Yes' ELSE 'No' END FROM (SELECT *, CASE WHEN greatest(1, n // 2) = n THEN greatest(1, n - 1) ELSE greatest(1, n // 2) END AS t FROM cc)"""),
    "multi_choice": _q(f"""SELECT image_id, label || '/' || r[t % 3 + 1] || '/' || r[(t + 1) % 3 + 1] || '/' || r[(t + 2) % 3 + 1] AS subject, (['B', 'A', 'C'])[t + 1] AS answer FROM (
  SELECT image_id, label, ['0-' || lo, (lo + 1) || '-' || mid, (mid + 1) || '-' || (mid + 1 + greatest(2, mid - lo - 1))] AS r, CAST(('0x' || substr(md5('0/' || image_id || '/' || label), 1, 4)) AS INT) % 3 AS t FROM (
    SELECT *, {_LOW} AS lo, {_MID} AS mid FROM (SELECT image_id, label, count(*) AS n, var_pop(score) AS v FROM d GROUP BY 1, 2 HAVING count(*) >= 4)))"""),
    "closer": _q("SELECT image_id, l1 || '/' || l2 AS subject, CASE WHEN bool_or(sure AND z1 < z2) THEN 'Yes' ELSE 'No' END AS answer FROM zp GROUP BY image_id, l1, l2"),
    "farther": _q("SELECT image_id, l1 || '/' || l2 AS subject, CASE WHEN bool_or(sure AND z1 > z2) THEN 'Yes' ELSE 'No' END AS answer FROM zp GROUP BY image_id, l1, l2"),
    "depth_ranking": _q(_top("SELECT image_id, label, min(z) AS v, min(det_idx) AS fs FROM dep GROUP BY 1, 2", "v", "v <= (1 - 0.2) * nv")),
}
