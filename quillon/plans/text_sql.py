"""SQL of the text, metric and statistics queries for DuckDB."""

from __future__ import annotations

from quillon.functions import text as T
from quillon.functions.names import SPLIT_NAMES
from quillon.operators.metrics import HELD_OUT

WS = T.WS
ONE = "WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY scored_at DESC, raw_prediction DESC) AS rn FROM predictions WHERE pred_id IS NOT NULL) WHERE rn = 1)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def steps(table: str, column: str, exprs: list[str]) -> str:
    """Nested selects over ``table`` that replace v step by step, starting from ``column``; '{{v}}' is the value so far."""
    sql = f"(SELECT *, {column} AS v FROM {table})"
    for e in exprs:
        sql = f"(SELECT * EXCLUDE (v), {e.replace('{v}', 'v')} AS v FROM {sql})"
    return sql


NORMALIZE = [f"lower({strip(chr(123) + 'v' + chr(125))})"]
NORMALIZE += [f"CASE WHEN starts_with({{v}}, {lit(p)}) THEN {strip(f'substr({{v}}, {len(p) + 1})')} ELSE {{v}} END" for p in T.PREFIXES]
NORMALIZE += [squeeze("translate({v}, chr(10) || chr(9) || '.!?;', '      ')"), "regexp_replace({v}, ' *, *', ',', 'g')"]
CLEAN = [strip("{v}")]
CLEAN += [f"CASE WHEN starts_with({{v}}, {lit(p)}) THEN {strip(f'substr({{v}}, {len(p) + 1})')} ELSE {{v}} END" for p in T.ROLES]
CLEAN += [f"regexp_replace({strip('split_part({v}, ' + lit('</s>') + ', 1)')}, {lit(chr(94) + chr(91) + chr(34) + chr(39) + '`]+|[' + chr(34) + chr(39) + '`]+$')}, '', 'g')", squeeze("lower({v})")]


def norm(column: str) -> str:
    """(pred_id, v) of a normalized column of p."""
    return f"(SELECT pred_id, v FROM {steps('p', f'coalesce({column}, {lit(chr(0))[:1]}{lit(chr(0))[-1:]})', NORMALIZE)})"


def clean(column: str) -> str:
    return f"(SELECT pred_id, v FROM {steps('p', f'coalesce({column}, {chr(39) * 2})', CLEAN)})"


def starts(v: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({v}, {lit(w)})" for w in words) + ")"


def has(v: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({v}, {lit(w)})" for w in words) + ")"


def polarity(v: str) -> str:
    return f"CASE WHEN {starts(v, T.YES_STARTS)} THEN 'yes' WHEN {starts(v, T.NO_STARTS)} THEN 'no' END"


def metres(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    n = f"TRY_CAST(nullif(regexp_extract({low}, '({T.NUMBER})', 1), '') AS DOUBLE)"
    after = f"regexp_extract({low}, '{T.NUMBER}((?s:.{{0,24}}))', 1)"
    return "CASE " + " ".join(f"WHEN {has(after, names)} THEN {n} * {f}" for names, f in T.UNITS) + f" ELSE {n} END"


def directions(v: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({v}, '\\b({'|'.join(w)})\\b') THEN '{k}' END" for k, w in sorted(T.DIRECTIONS.items())) + ")"


RELAXED = f"""{ONE}, r AS (
  SELECT p.*, g.v AS gn, s.v AS sn, {polarity('g.v')} AS gp, {polarity('s.v')} AS sp, {metres('gold_answer')} AS gm, {metres('raw_prediction')} AS sm, {directions('g.v')} AS gd, {directions('s.v')} AS sd
  FROM p JOIN {norm('gold_answer')} g USING (pred_id) JOIN {norm('raw_prediction')} s USING (pred_id)),
x AS (SELECT *, CASE WHEN gn = sn THEN 1 WHEN gp IS NOT NULL AND sp IS NOT NULL THEN CAST(gp = sp AS INT)
  WHEN gm IS NOT NULL AND sm IS NOT NULL THEN CAST(abs(gm - sm) <= greatest(0.05, abs(gm) * 0.15) AS INT)
  WHEN gd <> '' AND sd <> '' THEN CAST(gd = sd AS INT) ELSE 0 END AS relaxed FROM r)"""
_AK0 = f"regexp_replace(lower({strip('coalesce(gold_answer, ' + chr(39) * 2 + ')')}), '[.!?]+$', '')"
ANSWER_KIND = f"""CASE WHEN {_AK0} IN ('yes', 'no') THEN 'yes_no' WHEN regexp_matches({_AK0}, '{T.NUMBER}') THEN 'numeric' WHEN {has(_AK0, T.ANSWER_DIRECTIONS)} THEN 'directional'
  WHEN len(list_filter(string_split({squeeze(_AK0)}, ' '), lambda w: w <> '')) <= 4 THEN 'short_phrase' ELSE 'long_phrase' END"""
_Q = "lower(coalesce(question, ''))"
QUESTION_KIND = f"CASE WHEN regexp_matches({_Q}, '{T.ASKS_YES_NO}') OR lower({strip('coalesce(gold_answer, ' + chr(39) * 2 + ')')}) IN ('yes', 'no') THEN 'YesNoSpatial' " + " ".join(f"WHEN {has(_Q, w)} THEN '{k}'" for k, w in T.QUESTION_KINDS) + " ELSE 'GeneralSpatial' END"
PREPOSITION = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(question, ''), '{p}') THEN '{n}'" for n, p in T.PREPOSITIONS) + " ELSE 'unknown' END"
_TYPE = "lower(regexp_replace(question_type, '[^A-Za-z0-9]', '', 'g'))"
_HELD = "(" + ", ".join(lit(h.lower()) for h in HELD_OUT) + ")"
_YN = """regexp_replace(lower({0}), '^[`''"\\s(\\{{\\[]+', '')""".replace("{0}", strip("coalesce(raw_prediction, '')")).replace("{{", "{")
_C = "n"

#: Each id of qa_rows once, as ingested last: t its plain type, s its scene, x its plain split.
_BASE = r"regexp_replace(lower(trim(regexp_extract(replace(trim(source_id), '\', '/'), '([^/]*)$', 1))), '-', '_', 'g')"
_BARE = rf"regexp_replace({_BASE}, '\.[a-z0-9]{{1,5}}$', '')"
_STEM = rf"regexp_extract({_BARE} || ' ', '^((?:[a-z]+_)+(?:[0-9]+|[0-9a-f]{{8,}}))(?:[^0-9a-z])', 1)"
_SCENE = rf"nullif(regexp_replace(CASE WHEN {_STEM} = '' THEN {_BARE} ELSE {_STEM} END, '_0+([0-9]+)$', '_\1'), '')"
_SPLIT = "CASE lower(trim(regexp_replace(split, '\\s+', ' ', 'g'))) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPLIT_NAMES.items()) + " END"
QA = f"""WITH q AS (SELECT id, nullif(regexp_replace(lower(question_type), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'), '') AS t, {_SCENE} AS s, {_SPLIT} AS x, answer FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, question_type DESC NULLS LAST, source_id DESC NULLS LAST, split DESC NULLS LAST, answer DESC NULLS LAST) AS k FROM qa_rows WHERE id IS NOT NULL) WHERE k = 1)"""

SQL: dict[str, str] = {
    "normalize_answer": f"{ONE} SELECT pred_id, v AS value FROM {norm('raw_prediction')}",
    "parse_yes_no": f"""{ONE}, l AS (SELECT pred_id, {_YN} AS t FROM p), m AS (SELECT pred_id, regexp_extract(t, '^([a-z]*)', 1) AS f,
  list_sort(list_distinct(list_transform(regexp_extract_all(t, '\\b(yes|no|true|false|correct|incorrect)\\b', 1), lambda w: CASE WHEN w IN ('yes', 'true', 'correct') THEN 'yes' ELSE 'no' END))) AS k FROM l)
  SELECT pred_id, CASE WHEN f IN ('yes', 'true', 'correct') THEN 'yes' WHEN f IN ('no', 'false', 'incorrect') THEN 'no' WHEN len(k) = 1 THEN k[1] END AS value,
  CASE WHEN f IN ('yes', 'true', 'correct', 'no', 'false', 'incorrect') THEN 'first_token' WHEN len(k) = 1 THEN 'single_keyword' ELSE 'unparsed' END AS method FROM m""",
    "parse_int": f"{ONE} SELECT pred_id, TRY_CAST(nullif(regexp_extract(v, '(-?[0-9]+)', 1), '') AS BIGINT) AS value FROM {clean('raw_prediction')}",
    "parse_id_list": f"{ONE} SELECT pred_id, CASE WHEN v IN ('', 'none', 'no', 'n/a') THEN '' ELSE coalesce(array_to_string(list_transform(regexp_extract_all(v, '([0-9]+)', 1), lambda x: CAST(TRY_CAST(x AS BIGINT) AS VARCHAR)), ', '), '') END AS value FROM {clean('raw_prediction')}",
    "parse_action": f"{ONE} SELECT pred_id, CASE " + " ".join(f"WHEN {has('v', w)} THEN '{a}'" for a, w in T.ACTIONS) + f" END AS action, CASE " + " ".join(f"WHEN {has('v', w)} THEN '{a}'" for a, w in T.ACTIONS) + f" WHEN contains(v, 'facing') THEN 'already facing' END AS turn FROM (SELECT pred_id, replace(v, '_', ' ') AS v FROM {clean('raw_prediction')})",
    "parse_direction": f"{ONE} SELECT pred_id, CASE WHEN c IN ({', '.join(map(lit, T.COMPASS))}) THEN upper(c[1]) || c[2:] END AS compass, CASE WHEN e IN ({', '.join(map(lit, T.EGOCENTRIC))}) THEN e END AS egocentric FROM (SELECT pred_id, regexp_replace(v, '[- ]', '', 'g') AS c, replace(v, ' ', '-') AS e FROM {clean('raw_prediction')})",
    "polarity_and_metres": f"{ONE} SELECT pred_id, {polarity('v')} AS polarity, {metres('raw_prediction')} AS metres, {directions('v')} AS directions FROM p JOIN {norm('raw_prediction')} USING (pred_id)",
    "relaxed_correct": f"{RELAXED} SELECT pred_id, relaxed FROM x",
    "classify_question": f"{ONE} SELECT pred_id, {QUESTION_KIND} AS question_kind, {ANSWER_KIND} AS answer_kind, {PREPOSITION} AS preposition FROM p",
    "accuracy_by_type": f"{ONE} SELECT coalesce({_TYPE}, 'unknown') AS key, count(*) AS n, coalesce(avg(is_correct), 0.0) AS accuracy FROM p GROUP BY 1",
    "seen_unseen": f"""{ONE}, t AS (SELECT is_correct AS c, coalesce({_TYPE} IN {_HELD}, false) AS held FROM p)
  SELECT 'overall_accuracy' AS metric, coalesce(avg(c), 0.0) AS value FROM t UNION ALL SELECT 'seen_accuracy', coalesce(avg(c), 0.0) FROM t WHERE NOT held UNION ALL SELECT 'unseen_accuracy', coalesce(avg(c), 0.0) FROM t WHERE held""",
    "macro_accuracy": f"""{RELAXED}, b AS (SELECT coalesce({_TYPE}, 'unknown') AS q, {ANSWER_KIND} AS a, is_correct AS strict, relaxed FROM x),
  g AS (SELECT 'overall' AS l, avg(strict) AS strict, avg(relaxed) AS relaxed FROM b UNION ALL SELECT 'macro_question_type', avg(strict), avg(relaxed) FROM b GROUP BY q UNION ALL SELECT 'macro_answer_type', avg(strict), avg(relaxed) FROM b GROUP BY a)
  SELECT l || '_strict' AS metric, avg(strict) AS value FROM g GROUP BY l UNION ALL SELECT l || '_relaxed', avg(relaxed) FROM g GROUP BY l""",
    "pair_set_accuracy": f"""{ONE}, r AS (SELECT source_id AS grp, {PREPOSITION} AS prep, is_correct AS c FROM p),
  q AS (SELECT grp, CASE WHEN prep IN ('left_of', 'right_of') THEN 'lr' WHEN prep IN ('on', 'under') THEN 'ou' WHEN prep IN ('in_front_of', 'behind') THEN 'fb' END AS pair, c FROM r),
  pr AS (SELECT min(c) AS ok FROM q WHERE pair IS NOT NULL GROUP BY grp, pair HAVING count(*) >= 2), st AS (SELECT min(c) AS ok FROM r GROUP BY grp HAVING count(*) >= 4)
  SELECT 'pair_accuracy' AS metric, avg(ok) AS value, count(*) AS n FROM pr UNION ALL SELECT 'set_accuracy', avg(ok), count(*) FROM st""",
    "confusion": f"{ONE} SELECT coalesce(gold_normalized, 'unknown') AS gold, coalesce(normalized_prediction, 'unknown') AS predicted, count(*) AS n FROM p GROUP BY 1, 2",
    "delta": f"""{ONE}, a AS (SELECT model_family, coalesce({_TYPE}, 'unknown') AS question_type, phase, avg(is_correct) AS v FROM p GROUP BY 1, 2, 3)
  SELECT b.model_family, b.question_type, b.v AS before, f.v AS after, f.v - b.v AS delta FROM a b JOIN a f ON f.model_family = b.model_family AND f.question_type = b.question_type WHERE b.phase = 'before_finetune' AND f.phase = 'after_finetune'""",
    "equalized_sample": f"""{ONE}, m AS (SELECT least(min(c), 300) AS m FROM (SELECT count(*) AS c FROM p GROUP BY run_name)),
  k AS (SELECT run_name, is_correct, row_number() OVER (PARTITION BY run_name ORDER BY md5(CAST(pred_id AS VARCHAR)), pred_id) AS k FROM p)
  SELECT m AS per_group, avg(v) AS value FROM (SELECT run_name, m, avg(is_correct) AS v FROM k, m WHERE k <= m GROUP BY 1, 2) GROUP BY 1""",
    "dataset_stats": f"""{QA}, u AS (SELECT t, s, x, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT '*', s, x, count(*) FROM q GROUP BY ALL),
  g AS (SELECT t AS question_type, CAST(sum(n) AS BIGINT) AS qa_pairs, count(DISTINCT s) AS images, {', '.join(f"CAST(coalesce(sum(n) FILTER (x = '{x}'), 0) AS BIGINT) AS {x}, count(DISTINCT s) FILTER (x = '{x}') AS {x}_images" for x in ('train', 'evaluation', 'test'))} FROM u WHERE t IS NOT NULL GROUP BY 1)
  SELECT *, qa_pairs / (SELECT qa_pairs FROM g WHERE question_type = '*') AS share FROM g""",
    "top_answers": f"""{QA} SELECT question_type, answer, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY n DESC, first, answer NULLS FIRST) AS rank FROM (
  SELECT t AS question_type, answer, count(*) AS n, min(id) AS first FROM q WHERE t IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 10""",
    "answer_distribution": """SELECT answer, n, row_number() OVER (ORDER BY CASE WHEN regexp_matches(answer, '^[0-9]{1,9}$') THEN TRY_CAST(answer AS INT) ELSE 999 END, answer) AS position FROM (SELECT answer, count(*) AS n FROM qa_rows WHERE answer IS NOT NULL GROUP BY 1)""",
    "leakage_guard": f"{QA} SELECT t AS question_type, count(*) AS rows FROM q WHERE x = 'train' AND t IN {_HELD} GROUP BY 1",
    "dedup_hash": "SELECT substr(sha256(image.bytes), 1, 16) AS hash, min(id) AS id, count(DISTINCT id) AS rows FROM qa_rows WHERE image.bytes IS NOT NULL GROUP BY 1",
    "last_event_per_run": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1",
    "time_of_day_filter": "SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events WHERE hour(ts) >= 8 AND hour(ts) < 18 GROUP BY 1, 2",
    "scene_filter": "SELECT image_id, source_id, row_number() OVER (ORDER BY image_id) - 1 AS idx FROM scenes WHERE lower(trim(timeofday)) = 'daytime' AND coalesce(lower(trim(weather)), '') NOT IN ('foggy', 'snowy', 'rainy')",
    "image_box_join": "SELECT s.image_id, s.source_id, count(*) AS boxes, max(d.score) AS best_score FROM scenes s JOIN (SELECT DISTINCT * FROM detections) d ON d.image_id = s.image_id AND d.img_w = s.img_w AND d.img_h = s.img_h GROUP BY 1, 2",
    "class_counts": "",
    "iou_pairs": "",
    "bbox_edge_dist": "",
    "best_frame": "",
    "qa_pairs_from_turns": f"""WITH t AS (SELECT pred_id AS conv_id, 1 AS turn, 'user' AS role, question AS text FROM predictions UNION SELECT pred_id, 2, 'user', gold_answer FROM predictions WHERE is_correct = 0 UNION SELECT pred_id, 3, 'assistant', raw_prediction FROM predictions UNION SELECT pred_id, 4, 'assistant', normalized_prediction FROM predictions),
  u AS (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text FROM t WHERE regexp_replace(text, '{WS}+', '', 'g') <> '' AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, prev_text AS question, text AS answer FROM u WHERE role = 'assistant' AND prev_role = 'user'""",
}
from quillon.plans.scene_sql import BOXES  # noqa: E402

SQL |= {
    "class_counts": BOXES + "SELECT image_id, label, n, first_seen FROM cc",
    "iou_pairs": BOXES + """, pr AS (SELECT a.image_id, a.det_idx AS a_idx, b.det_idx AS b_idx, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM d a JOIN d b ON b.image_id = a.image_id AND a.det_idx < b.det_idx)
  SELECT image_id, a_idx, b_idx, i / (s - i) AS iou FROM pr WHERE i > 0""",
    "bbox_edge_dist": BOXES + """SELECT a.image_id, a.det_idx, sqrt(gx * gx + gy * gy) AS gap FROM (SELECT d.image_id, d.det_idx, greatest(0, d.x1 - c.x2, c.x1 - d.x2) AS gx, greatest(0, d.y1 - c.y2, c.y1 - d.y2) AS gy FROM d JOIN clk c USING (image_id) WHERE d.label <> 'clock') a""",
    "best_frame": BOXES + """, f AS (SELECT image_id // 10 AS file, image_id, count(*) AS n, avg((x2 - x1) * (y2 - y1)) AS a FROM d GROUP BY 1, 2), s AS (SELECT *, 0.5 * (n / max(n) OVER (PARTITION BY file) + a / max(a) OVER (PARTITION BY file)) AS score FROM f)
  SELECT file, image_id, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, image_id) AS k FROM s) WHERE k = 1""",
}
