"""SQL of the scene questions for DuckDB, written with joins and windows."""

from __future__ import annotations

BOXES = """
WITH RECURSIVE raw AS (
  SELECT DISTINCT image_id, det_idx, img_w, img_h, nullif(trim(regexp_replace(lower(label), '[_\\s]+', ' ', 'g')), '') AS label, score,
         least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2
  FROM detections WHERE score >= 0.2),
d AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM raw WHERE label IS NOT NULL),
cc AS (SELECT image_id, label, count(*) AS n, min(det_idx) AS first_seen FROM d GROUP BY 1, 2),
img AS (SELECT image_id, max(img_w) AS w, max(img_h) AS h, greatest(max(img_w), max(img_h)) / 4032.0 AS s, count(*) AS boxes FROM d GROUP BY 1),
gate AS (SELECT image_id, w, h, s FROM img WHERE boxes = 1 OR image_id IN (SELECT image_id FROM cc WHERE n = 1)),
clk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS k FROM d WHERE label = 'clock') WHERE k = 1),
pts AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY cx, det_idx) AS rn FROM d WHERE label IN ('bench', 'stop sign')),
fold AS (
  SELECT image_id, label, det_idx, cx, cy, x1, y1, x2, y2, rn, 1 AS g, 1 AS n, cx AS sx FROM pts WHERE rn = 1
  UNION ALL
  SELECT p.image_id, p.label, p.det_idx, p.cx, p.cy, p.x1, p.y1, p.x2, p.y2, p.rn,
         CASE WHEN abs(p.cx - f.sx / f.n) <= 40 THEN f.g ELSE f.g + 1 END,
         CASE WHEN abs(p.cx - f.sx / f.n) <= 40 THEN f.n + 1 ELSE 1 END,
         CASE WHEN abs(p.cx - f.sx / f.n) <= 40 THEN f.sx + p.cx ELSE p.cx END
  FROM fold f JOIN pts p ON p.image_id = f.image_id AND p.label = f.label AND p.rn = f.rn + 1),
place AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY g, cy, cx, det_idx) AS id FROM fold),
obj AS (SELECT *, CASE WHEN label = 'person' THEN 'bench' ELSE 'stop sign' END AS goes_to FROM d WHERE label IN ('person', 'zebra', 'elephant', 'giraffe')),
od AS (
  SELECT o.image_id, o.goes_to, o.det_idx, p.id, sqrt((p.cx - o.cx) * (p.cx - o.cx) + (p.cy - o.cy) * (p.cy - o.cy)) AS dist
  FROM obj o JOIN place p ON p.image_id = o.image_id AND p.label = o.goes_to),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, goes_to, det_idx ORDER BY dist, id) AS k,
         lead(dist) OVER (PARTITION BY image_id, goes_to, det_idx ORDER BY dist, id) - dist AS gap FROM od),
asg AS (SELECT r.*, gap IS NULL OR gap > greatest(8, 80 * s) AS ok FROM ranked r JOIN img USING (image_id) WHERE k = 1),
bad AS (SELECT DISTINCT image_id, goes_to FROM asg WHERE NOT ok),
occ AS (
  SELECT p.image_id, p.label, p.id, count(a.det_idx) AS n FROM place p
  LEFT JOIN asg a ON a.image_id = p.image_id AND a.goes_to = p.label AND a.id = p.id
  WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.image_id = p.image_id AND b.goes_to = p.label) GROUP BY 1, 2, 3),
cd AS (SELECT p.image_id, p.label, p.id, sqrt((p.cx - c.cx) * (p.cx - c.cx) + (p.cy - c.cy) * (p.cy - c.cy)) AS dist FROM place p JOIN clk c USING (image_id)),
cr AS (SELECT *, row_number() OVER w AS k, lead(dist) OVER w - dist AS gap FROM cd WINDOW w AS (PARTITION BY image_id, label ORDER BY dist, id)),
ord AS (
  SELECT cr.* FROM cr JOIN gate USING (image_id)
  WHERE NOT EXISTS (SELECT 1 FROM cr c2 JOIN img i2 USING (image_id) WHERE c2.image_id = cr.image_id AND c2.label = cr.label AND c2.gap <= greatest(8, 80 * s))),
asked AS (SELECT p.*, c.cx AS bx, c.cy AS bby, c.x1 AS bx1, c.y1 AS by1, c.x2 AS bx2, c.y2 AS by2, w, h, s FROM place p JOIN clk c USING (image_id) JOIN gate USING (image_id)),
dot AS (SELECT g.image_id, c.cx, c.cy, dot_x - c.cx AS hx, dot_y - c.cy AS hy FROM gate g JOIN clk c USING (image_id) JOIN scenes sc USING (image_id) WHERE dot_x IS NOT NULL AND dot_y IS NOT NULL)
"""

_NAMES = {"compass": "['East', 'Southeast', 'South', 'Southwest', 'West', 'Northwest', 'North', 'Northeast']", "relative": "['front', 'front-right', 'right', 'back-right', 'back', 'back-left', 'left', 'front-left']"}


def _sector(angle: str, names: str, edge: str) -> str:
    r = f"(({angle} + pi() / 8) - floor(({angle} + pi() / 8) / (pi() / 4)) * (pi() / 4))"
    k = f"CAST(((CAST(round_even({angle} / (pi() / 4), 0) AS INT) % 8) + 8) % 8 AS INT)"
    return f"CASE WHEN least({r}, pi() / 4 - {r}) > {edge} THEN ({_NAMES[names]})[{k} + 1] END"


def _wrap(a: str) -> str:
    return f"CASE WHEN {a} > pi() THEN {a} - 2 * pi() WHEN {a} <= -pi() THEN {a} + 2 * pi() ELSE {a} END"


def _q(body: str) -> str:
    return BOXES + f"SELECT image_id, CAST(target AS BIGINT) AS target, CAST(answer AS VARCHAR) AS answer FROM ({body}) WHERE answer IS NOT NULL"


def _arrived(gap: str) -> str:
    return f"CASE WHEN abs({gap} - 190 * s) <= greatest(8, 35 * s) THEN NULL WHEN {gap} < 190 * s THEN 'Yes' ELSE 'No' END"


def _gap(a: str, b: str) -> str:
    """Edge distance of two boxes given as prefixes of their columns."""
    x = f"greatest(0, {b}x1 - {a}x2, {a}x1 - {b}x2)"
    y = f"greatest(0, {b}y1 - {a}y2, {a}y1 - {b}y2)"
    return f"sqrt({x} * {x} + {y} * {y})"


def _entry(by: str) -> str:
    """Entry of the segment b to c into the box of o grown by ``by``."""
    ax, bx = f"((o.x1 - {by} - a.bx) / nullif(a.cx - a.bx, 0))", f"((o.x2 + {by} - a.bx) / nullif(a.cx - a.bx, 0))"
    ay, by_ = f"((o.y1 - {by} - a.bby) / nullif(a.cy - a.bby, 0))", f"((o.y2 + {by} - a.bby) / nullif(a.cy - a.bby, 0))"
    low = f"greatest(0, coalesce(least({ax}, {bx}), 0), coalesce(least({ay}, {by_}), 0))"
    high = f"least(1, coalesce(greatest({ax}, {bx}), 1), coalesce(greatest({ay}, {by_}), 1))"
    inside = f"(a.cx <> a.bx OR a.bx BETWEEN o.x1 - {by} AND o.x2 + {by}) AND (a.cy <> a.bby OR a.bby BETWEEN o.y1 - {by} AND o.y2 + {by})"
    return f"CASE WHEN {inside} AND {low} <= {high} THEN {low} END"


def _ways(label: str) -> str:
    """(image_id, id, answer) of every target."""
    m = "greatest((a.bx2 - a.bx1) / 2, (a.by2 - a.by1) / 2)"
    edge = "greatest(8, 65 * a.s)"
    v = _wrap("(atan2(oy, ox) - atan2(hy, hx))")
    return f"""
  WITH tgt AS (SELECT * FROM asked WHERE label = '{label}' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.image_id = asked.image_id AND bad.goes_to = '{label}')),
  tests AS (
    SELECT a.image_id, a.id, a.w, a.h, a.bx, a.bby, a.cx - a.bx AS hx, a.cy - a.bby AS hy, o.cx - a.bx AS ox, o.cy - a.bby AS oy, {_entry(m)} AS t,
           (({_entry(f'greatest(0, {m} - {edge})')}) IS NULL) <> (({_entry(f'({m} + {edge})')}) IS NULL) AS unsure
    FROM tgt a JOIN d o ON o.image_id = a.image_id
    LEFT JOIN asg ON asg.image_id = a.image_id AND asg.det_idx = o.det_idx AND asg.goes_to = '{label}'
    WHERE o.label IN ('bench', 'stop sign', 'person', 'zebra', 'elephant', 'giraffe') AND NOT (o.label = '{label}' AND o.det_idx = a.det_idx) AND (asg.id IS NULL OR asg.id <> a.id)),
  hits AS (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY t, ox + bx, oy + bby) AS k, lead(t) OVER (PARTITION BY image_id, id ORDER BY t, ox + bx, oy + bby) - t AS gap FROM tests WHERE t IS NOT NULL),
  unsure AS (SELECT DISTINCT image_id, id FROM tests WHERE unsure)
  SELECT tgt.image_id, tgt.id, CASE
    WHEN hits.t IS NULL THEN 'keep straight'
    WHEN gap <= 0.04 OR abs({v}) <= pi() / 18 THEN NULL
    WHEN hx * oy - hy * ox > 0 THEN 'turn left'
    WHEN hx * oy - hy * ox < 0 THEN 'turn right'
    WHEN (hits.w / 2.0 - hits.bx) * -hy + (hits.h / 2.0 - hits.bby) * hx >= 0 THEN 'turn left' ELSE 'turn right' END AS answer
  FROM tgt LEFT JOIN hits ON hits.image_id = tgt.image_id AND hits.id = tgt.id AND hits.k = 1
  WHERE NOT EXISTS (SELECT 1 FROM unsure u WHERE u.image_id = tgt.image_id AND u.id = tgt.id)"""


SQL: dict[str, str] = {
    "count_people": _q("SELECT image_id, 0 AS target, count(*) FILTER (label = 'person') AS answer FROM d GROUP BY 1"),
    "count_animals": _q("SELECT image_id, 0 AS target, count(*) FILTER (label IN ('zebra', 'elephant', 'giraffe')) AS answer FROM d GROUP BY 1"),
    "arrived_bench": _q(f"SELECT image_id, id AS target, {_arrived('gap')} AS answer FROM (SELECT *, {_gap('b', 'p.')} AS gap FROM (SELECT * FROM asked WHERE label = 'bench') p)"),
    "arrived_animals": _q(f"""
  SELECT image_id, id AS target, CASE WHEN gap IS NULL THEN 'No' ELSE {_arrived('gap')} END AS answer FROM (
    SELECT p.image_id, p.id, p.s, min({_gap('p.b', 'o.')}) FILTER (o.det_idx IS NOT NULL) AS gap FROM asked p
    LEFT JOIN asg a ON a.image_id = p.image_id AND a.goes_to = 'stop sign' AND a.id = p.id
    LEFT JOIN d o ON o.image_id = a.image_id AND o.det_idx = a.det_idx
    WHERE p.label = 'stop sign' AND p.image_id IN (SELECT image_id FROM obj WHERE goes_to = 'stop sign')
      AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.image_id = p.image_id AND b.goes_to = 'stop sign') GROUP BY 1, 2, 3)"""),
    "heading": _q(f"SELECT image_id, 0 AS target, {_sector('atan2(hy, hx)', 'compass', 'pi() / 36')} AS answer FROM dot"),
    "count_at_closest_bench": _q("SELECT o.image_id, 0 AS target, c.n AS answer FROM ord o JOIN occ c ON c.image_id = o.image_id AND c.label = 'bench' AND c.id = o.id WHERE o.label = 'bench' AND o.k = 1"),
    "closest_bench_with_person": _q("""
  SELECT g.image_id, 0 AS target, CASE
    WHEN NOT EXISTS (SELECT 1 FROM obj WHERE obj.image_id = g.image_id AND goes_to = 'bench') THEN 0
    WHEN NOT EXISTS (SELECT 1 FROM ord WHERE ord.image_id = g.image_id AND label = 'bench') THEN NULL
    WHEN EXISTS (SELECT 1 FROM bad WHERE bad.image_id = g.image_id AND goes_to = 'bench') THEN NULL
    ELSE coalesce((SELECT arg_min(o.id, o.k) FROM ord o JOIN occ c ON c.image_id = o.image_id AND c.label = o.label AND c.id = o.id WHERE o.image_id = g.image_id AND o.label = 'bench' AND c.n > 0), 0) END AS answer
  FROM gate g WHERE g.image_id IN (SELECT image_id FROM clk) AND g.image_id IN (SELECT image_id FROM d WHERE label = 'bench')"""),
}
for _name, _label, _plural, _ks in (("bench", "bench", "benches", (1, 2)), ("stop_sign", "stop sign", "stop_signs", (3, 4))):
    _at = {"bench": "people_at_bench", "stop_sign": "animals_at_stop_sign"}[_name]
    _short = {"bench": "bench", "stop_sign": "stop"}[_name]
    _angle = "atan2(cy - bby, cx - bx)"
    _delta = _wrap("(atan2(p.cy - dot.cy, p.cx - dot.cx) - atan2(hy, hx))")
    SQL |= {
        _at: _q(f"SELECT image_id, id AS target, n AS answer FROM occ WHERE label = '{_label}'"),
        f"list_{_plural}_k": _q(f"SELECT image_id, k AS target, coalesce(string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) FILTER (n >= k), '0') AS answer FROM occ CROSS JOIN (VALUES ({_ks[0]}), ({_ks[1]})) v(k) WHERE label = '{_label}' GROUP BY 1, 2"),
        f"closest_{_name}": _q(f"SELECT image_id, 0 AS target, id AS answer FROM ord WHERE label = '{_label}' AND k = 1"),
        f"pairwise_{_name}": _q(f"""
  SELECT image_id, target, CASE WHEN abs(di - dj) > greatest(8, 80 * s) THEN CASE WHEN di < dj THEN i ELSE j END END AS answer FROM (
    SELECT a.image_id, g.s, a.id AS i, b.id AS j, a.dist AS di, b.dist AS dj, a.id * 1000 + b.id AS target,
           row_number() OVER (PARTITION BY a.image_id ORDER BY md5('0/' || a.image_id || '/' || a.id || '/' || b.id), a.id, b.id) AS k
    FROM cd a JOIN cd b ON b.image_id = a.image_id AND b.label = a.label AND a.id < b.id JOIN gate g ON g.image_id = a.image_id WHERE a.label = '{_label}') WHERE k <= 4"""),
        f"order_{_plural}": _q(f"SELECT image_id, 0 AS target, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY k) AS answer FROM ord WHERE label = '{_label}' GROUP BY 1"),
        f"direction_{_name}": _q(f"SELECT image_id, id AS target, {_sector(_angle, 'compass', 'pi() / 36')} AS answer FROM asked WHERE label = '{_label}'"),
        f"direction_closest_{_short}": _q(f"SELECT a.image_id, 0 AS target, {_sector('atan2(a.cy - a.bby, a.cx - a.bx)', 'compass', 'pi() / 36')} AS answer FROM asked a JOIN ord o ON o.image_id = a.image_id AND o.label = a.label AND o.id = a.id AND o.k = 1 WHERE a.label = '{_label}'"),
        f"avoid_to_{_name}": _q(f"SELECT image_id, id AS target, answer FROM ({_ways(_label)})"),
        f"avoid_to_closest_{_short}": _q(f"SELECT x.image_id, 0 AS target, answer FROM ({_ways(_label)}) x JOIN ord o ON o.image_id = x.image_id AND o.label = '{_label}' AND o.id = x.id AND o.k = 1"),
        f"turn_{_name}": _q(f"SELECT image_id, id AS target, CASE WHEN abs(abs(a) - pi() / 8) > pi() / 18 THEN CASE WHEN abs(a) <= pi() / 8 THEN 'already facing' WHEN a > 0 THEN 'turn right' ELSE 'turn left' END END AS answer FROM (SELECT p.image_id, p.id, {_delta} AS a FROM place p JOIN dot USING (image_id) WHERE p.label = '{_label}')"),
        f"relative_{_name}": _q(f"SELECT image_id, id AS target, {_sector('a', 'relative', 'pi() / 18')} AS answer FROM (SELECT p.image_id, p.id, {_delta} AS a FROM place p JOIN dot USING (image_id) WHERE p.label = '{_label}')"),
    }
