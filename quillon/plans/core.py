"""Queries and SQL of the core operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import box_questions, ensemble, metrics, scene_questions, schema_drift, sinks
from quillon.operators.scenes import boxes, scenes
from quillon.plans import box_sql, built, reports, scene_sql, text, text_sql
from quillon.sources import table
from quillon.streaming import log as stream_log


def _scenes(spark, d):
    return scenes(boxes(table(spark, d, "detections")), table(spark, d, "scenes"))


def _scene_query(build):
    return lambda spark, d: build(_scenes(spark, d))


def _box_query(build):
    return lambda spark, d: build(boxes(table(spark, d, "detections")))


def depth_stand_in(det):
    """Depths for boxes without a depth model: nearer the lower a box reaches into the image."""
    return det.select("image_id", "det_idx", (10.0 * F.col("img_h") / F.greatest(F.col("y2"), F.lit(1.0))).alias("mean_depth"))


def _depth_query(build):
    def run(spark, d):
        det = boxes(table(spark, d, "detections"))
        return build(det, depth_stand_in(det))

    return run


QUERIES = {name: _scene_query(build) for name, (_, build) in scene_questions.REGISTRY.items()}
QUERIES |= {name: _box_query(build) for name, (_, build) in box_questions.REGISTRY.items()}
QUERIES |= text.QUERIES
QUERIES |= built.QUERIES | reports.QUERIES


def box_fusion(spark, d):
    """Boxes of three stand-in models (by det_idx), as shares of their images, fused and brought back to pixels."""
    det = boxes(table(spark, d, "detections")).withColumn("model", F.concat(F.lit("m"), (F.col("det_idx") % 3).cast("string")))
    fused = ensemble.weighted_fusion(ensemble.normalized(det), {"m0": 1.0, "m1": 1.0, "m2": 1.0})
    sizes = det.groupBy("image_id").agg(F.max("img_w").alias("w"), F.max("img_h").alias("h"))
    return fused.join(sizes, "image_id").withColumns({c: F.col(c) * F.col("w" if c[0] == "x" else "h") for c in ("x1", "y1", "x2", "y2")}).drop("w", "h")


def match_boxes(spark, d):
    """Surer boxes matched to all boxes."""
    det = boxes(table(spark, d, "detections"))
    return ensemble.greedy_match(det.where("score >= 0.6"), det)


def label_text(spark, d):
    det = boxes(table(spark, d, "detections"))
    codes = F.create_map(*[F.lit(x) for kv in (("person", 0), ("bench", 13), ("stop sign", 11), ("elephant", 20), ("zebra", 22), ("giraffe", 23), ("clock", 74)) for x in kv])
    return sinks.label_text(det.withColumn("cls", F.try_element_at(codes, F.col("label"))))


def fsm_replay(spark, d):
    """The event log of each user replayed through a small state machine."""
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.lit("last").alias("obs_key"), F.col("event_type").alias("answer"))
    states = {"idle": (("last",), {("view",): "looking", ("signup",): "member"}), "looking": (("last",), {("purchase",): "buyer", ("error",): "idle"}), "buyer": (("last",), {("error",): "idle"}), "member": (("last",), {("purchase",): "buyer"})}
    return stream_log.run_machine(log, states, "idle")


QUERIES |= {
    "box_fusion": box_fusion,
    "match_boxes": match_boxes,
    "label_text": label_text,
    "fsm_replay": fsm_replay,
    "windowed_accuracy": lambda spark, d: stream_log.windowed_accuracy(metrics.once(table(spark, d, "predictions")), time="scored_at", key="model_family", correct="is_correct").withColumn("start", F.unix_timestamp("start")),
    "event_newest": lambda spark, d: stream_log.newest(table(spark, d, "events"), "user_id", "ts", ["event_id", "event_type"]),
    "numbered_qa": lambda spark, d: sinks.numbered(table(spark, d, "scenes").select("source_id", "image_id"), ["source_id"]),
    "conversation_lines": lambda spark, d: sinks.conversations(table(spark, d, "qa_rows")),
}
QUERIES |= {name: _depth_query(build) for name, (_, build) in box_questions.DEPTH.items()}
QUERIES |= {
    "p6_found": lambda spark, d: schema_drift.changes(table(spark, d, "final_test_report_files")),
    "p6_table": lambda spark, d: schema_drift.promote(
        schema_drift.ingest(table(spark, d, "final_test_report_files")),
        {"eval_seconds": "bigint", "gpu_hours": "double", "empty_replies": "bigint", "operator_note": "string"},
    ),
}

_FORMS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema_drift.WORD_FORMS.items())
_WORDS = f"""array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(string_split(lower(regexp_replace(regexp_replace(field, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_'),
  lambda w: string_split(CASE w {_FORMS} ELSE w END, '_'))), lambda w: w <> '' AND w NOT IN ({', '.join(f"'{w}'" for w in sorted(schema_drift.FILLERS))})))), ' ')"""
_MEASURE = f"CASE {_WORDS} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schema_drift.ALIASES.items()) + f" WHEN '' THEN lower(field) ELSE replace({_WORDS}, ' ', '_') END"
#: Changes from file to file, for files that hold each measure under one name, as all of the driver's do.
P6 = f"""WITH f AS (SELECT * FROM (SELECT file_id, series_id, written_at, payload, row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC, payload DESC) AS k FROM final_test_report_files WHERE file_id IS NOT NULL)
  WHERE k = 1 AND series_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
o AS (SELECT file_id, series_id, payload, row_number() OVER (PARTITION BY series_id ORDER BY written_at, file_id) AS pos FROM f),
x AS (SELECT file_id, series_id, pos, payload, unnest(json_keys(payload)) AS field FROM o),
t AS (SELECT file_id, series_id, pos, field, {_MEASURE} AS measure, CASE json_type(payload, '$."' || field || '"') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM x),
p AS (SELECT *, lag(pos) OVER w AS ppos, lag(field) OVER w AS pfield, lead(pos) OVER w AS npos FROM t WINDOW w AS (PARTITION BY series_id, measure ORDER BY pos)),
s AS (SELECT *, sum(CASE WHEN ppos = pos - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, measure ORDER BY pos) AS streak FROM p),
l AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY series_id, measure, streak ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s)
SELECT file_id, field, 'added' AS change FROM l WHERE pos > 1 AND ppos IS DISTINCT FROM pos - 1
UNION ALL SELECT file_id, field, 'renamed' FROM l WHERE ppos = pos - 1 AND pfield <> field
UNION ALL SELECT file_id, field, 'type_changed' FROM l WHERE kind IS NOT NULL AND past IS NOT NULL AND kind <> past
UNION ALL SELECT n.file_id, l.field, 'removed' FROM l JOIN o n ON n.series_id = l.series_id AND n.pos = l.pos + 1 WHERE l.npos IS DISTINCT FROM l.pos + 1"""

SQL: dict[str, str] = (
    scene_sql.SQL
    | box_sql.SQL
    | text_sql.SQL
    | built.SQL
    | reports.SQL
    | {
        "windowed_accuracy": text_sql.ONE + " SELECT CAST(floor(epoch(scored_at) / 3600) AS BIGINT) * 3600 AS start, model_family AS key, count(*) AS n, avg(is_correct) AS accuracy FROM p WHERE scored_at IS NOT NULL GROUP BY 1, 2",
        "p6_found": P6,
        "event_newest": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "label_text": scene_sql.BOXES
        + """SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', CASE label WHEN 'person' THEN 0 WHEN 'bench' THEN 13 WHEN 'stop sign' THEN 11 WHEN 'elephant' THEN 20 WHEN 'zebra' THEN 22 WHEN 'giraffe' THEN 23 WHEN 'clock' THEN 74 END,
  floor((x1 + x2) / 2 / img_w * 1e6 + 0.5) / 1e6, floor((y1 + y2) / 2 / img_h * 1e6 + 0.5) / 1e6, floor((x2 - x1) / img_w * 1e6 + 0.5) / 1e6, floor((y2 - y1) / img_h * 1e6 + 0.5) / 1e6), chr(10) ORDER BY det_idx) AS text FROM d GROUP BY 1""",
        "conversation_lines": """SELECT '{"image":"' || substr(sha256(image.bytes), 1, 16) || '.jpg","conversations":[' || CASE WHEN question IS NULL THEN '{}' ELSE '{"value":' || to_json(question) || '}' END || ',' ||
  CASE WHEN answer IS NULL THEN '{}' ELSE '{"value":' || to_json(answer) || '}' END || ']' || CASE WHEN question_type IS NULL THEN '' ELSE ',"question_type":' || to_json(question_type) END || '}' AS value FROM qa_rows WHERE image.bytes IS NOT NULL""",
        "objects_in_row": scene_sql.BOXES
        + """, o AS (SELECT image_id, cx, cy, img_h, row_number() OVER (PARTITION BY image_id ORDER BY cx, det_idx) AS k FROM d),
  win AS (SELECT a.image_id, a.k AS s, b.k AS e, any_value(c.img_h) AS h, count(*) AS n, var_pop(c.cx) AS vx, var_pop(c.cy) AS vy, covar_pop(c.cx, c.cy) AS vxy
          FROM o a JOIN o b ON b.image_id = a.image_id AND b.k >= a.k + 2 JOIN o c ON c.image_id = a.image_id AND c.k BETWEEN a.k AND b.k GROUP BY 1, 2, 3)
  SELECT image_id, '' AS subject, CASE WHEN min(greatest(0, vy - CASE WHEN vx > 1e-9 THEN vxy * vxy / vx ELSE 0 END) / (h * h)) < 0.1 THEN 'Yes' ELSE 'No' END AS answer FROM win GROUP BY 1""",
        "fsm_replay": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_type AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
  t(s, a, n) AS (VALUES ('idle', 'view', 'looking'), ('idle', 'signup', 'member'), ('looking', 'purchase', 'buyer'), ('looking', 'error', 'idle'), ('buyer', 'error', 'idle'), ('member', 'purchase', 'buyer')),
  r AS (SELECT e.run_id, e.seq, e.k, coalesce(t.n, 'idle') AS state, coalesce(t.n, 'idle') <> 'idle' AS changed FROM e LEFT JOIN t ON t.s = 'idle' AND t.a = e.a WHERE k = 1
    UNION ALL SELECT e.run_id, e.seq, e.k, coalesce(t.n, r.state), coalesce(t.n, r.state) <> r.state FROM r JOIN e ON e.run_id = r.run_id AND e.k = r.k + 1 LEFT JOIN t ON t.s = r.state AND t.a = e.a)
  SELECT run_id, seq, state, changed FROM r""",
        "numbered_qa": "SELECT source_id, image_id, row_number() OVER (ORDER BY source_id) - 1 AS id FROM scenes",
    }
)
