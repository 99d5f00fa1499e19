"""Queries of generated QA rows and of predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import box_questions, generate, scene_questions, wordings
from quillon.operators.scenes import boxes
from quillon.plans import box_sql, scene_sql
from quillon.sources import table

#: Box questions whose options are drawn in Python and so differ from SQL.
DRAWN = ("objects_in_row", "objects_in_line", "most_clustered")
BOX_SET = [name for name in box_questions.REGISTRY if name not in DRAWN]


def _det(spark, d):
    return boxes(table(spark, d, "detections"))


def qa_rows_built(spark, d):
    """All scene questions over all images, as numbered QA rows."""
    return generate.qa_rows(table(spark, d, "detections"), table(spark, d, "scenes"))


def box_qa_built(spark, d):
    """All box questions that SQL can express over all images, as numbered QA rows."""
    return generate.qa_rows(table(spark, d, "detections"), table(spark, d, "scenes"), [{"name": box_questions.REGISTRY[n][0]} for n in BOX_SET])


def image_predicates(spark, d):
    """(image_id, predicate) of each predicate that an image meets."""
    det = _det(spark, d)
    named = {"single": generate.at_least_one_single, "three_classes": generate.at_least_classes(3), "ten_boxes": generate.at_least_boxes(10), "clusters": generate.has_clusters(50.0), "apart": generate.apart}
    out = None
    for name, p in named.items():
        rows = p(det).select("image_id", F.lit(name).alias("predicate"))
        out = rows if out is None else out.unionByName(rows)
    return out


def applicable_boxes(spark, d):
    """Boxes of images with a cluster and a class of one box."""
    return generate.applicable(_det(spark, d), [generate.at_least_one_single, generate.has_clusters(50.0)]).select("image_id", "det_idx", "label")


def question_context(spark, d):
    rows = generate.question_context(_det(spark, d))
    return rows.select("image_id", F.size("areas").alias("n"), F.aggregate("areas", F.lit(0.0), lambda a, x: a + x).alias("area"), F.size("by_class").alias("classes"))


QUERIES = {
    "qa_rows_built": qa_rows_built,
    "box_qa_built": box_qa_built,
    "question_counts": lambda spark, d: generate.question_counts(qa_rows_built(spark, d)),
    "image_predicates": image_predicates,
    "applicable_boxes": applicable_boxes,
    "question_context": question_context,
    "first_images": lambda spark, d: generate.first_images(_det(spark, d), 50, 8).select("image_id", "det_idx"),
    "prompt_override": lambda spark, d: generate.with_prompt(table(spark, d, "qa_rows"), "ClosestBench", "Name the nearest bench.").select("id", "question", "answer").distinct(),
    "unknown_labels": lambda spark, d: generate.unknown_labels(_det(spark, d)),
    "category_ids": lambda spark, d: generate.large_boxes(_det(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", generate.category_id(F.col("label")).alias("category_id"), generate.category_name(generate.category_id(F.col("label"))).alias("category")),
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scene_text(kind: str) -> str:
    text = _lit(wordings.SCENE[kind])
    for mark, value in (("{i}", "target // 1000"), ("{j}", "target % 1000"), ("{n}", "target")):
        if mark in wordings.SCENE[kind]:
            text = f"replace({text}, '{mark}', CAST({value} AS VARCHAR))"
    return text


def _box_text(kind: str) -> str:
    text = _lit(wordings.BOX[kind].replace("{N}", "3").replace("{M}", "3"))
    if kind == "LessThanThresholdHowMany":
        text = f"CASE WHEN split_part(subject, '/', 2) = '0' THEN {_lit(wordings.ANY)} ELSE {text} END"
    for k, name in enumerate("abcd"):
        if "{" + name + "}" in wordings.BOX[kind]:
            text = f"replace({text}, '{{{name}}}', split_part(subject, '/', {k + 1}))"
    return text


def _numbered(parts: list[str]) -> str:
    return f"""SELECT row_number() OVER (ORDER BY q.image_id, o, item, question, answer) - 1 AS id, q.image_id, s.source_id, question_type, question, answer
FROM ({' UNION ALL '.join(parts)}) q LEFT JOIN scenes s ON s.image_id = q.image_id"""


_SCENE = [f"SELECT image_id, {o} AS o, target AS item, '{kind}' AS question_type, {_scene_text(kind)} AS question, answer FROM ({scene_sql.SQL[name]})" for o, (name, (kind, _)) in enumerate(scene_questions.ASKS.items())]
_BOX = [f"SELECT image_id, {o} AS o, 0 AS item, '{box_questions.REGISTRY[n][0]}' AS question_type, {_box_text(box_questions.REGISTRY[n][0])} AS question, answer FROM ({box_sql.SQL[n]})" for o, n in enumerate(BOX_SET)]
_B = scene_sql.BOXES
_SINGLE = "SELECT image_id FROM gate"
_NEAR = "SELECT DISTINCT a.image_id FROM d a JOIN d b ON b.image_id = a.image_id AND a.det_idx < b.det_idx WHERE sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) < 50"
_NAMES = "[" + ", ".join(_lit(c) for c in generate.CATEGORY_NAMES) + "]"

SQL = {
    "qa_rows_built": _numbered(_SCENE),
    "box_qa_built": _numbered(_BOX),
    "question_counts": f"SELECT question_type, count(*) AS qa_pairs FROM ({' UNION ALL '.join(_SCENE)}) GROUP BY 1",
    "image_predicates": _B + f"""SELECT image_id, 'single' AS predicate FROM ({_SINGLE}) UNION ALL SELECT image_id, 'three_classes' FROM cc GROUP BY image_id HAVING count(*) >= 3
  UNION ALL SELECT image_id, 'ten_boxes' FROM img WHERE boxes >= 10 UNION ALL SELECT image_id, 'clusters' FROM ({_NEAR})
  UNION ALL SELECT DISTINCT a.image_id, 'apart' FROM d a JOIN d b ON b.image_id = a.image_id AND a.det_idx < b.det_idx AND a.label <> b.label WHERE least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1)""",
    "applicable_boxes": _B + f"SELECT image_id, det_idx, label FROM d WHERE image_id IN ({_SINGLE}) AND image_id IN ({_NEAR})",
    "question_context": _B + "SELECT image_id, CAST(count(*) AS INT) AS n, sum(greatest(x2 - x1, 1) * greatest(y2 - y1, 1)) AS area, CAST(count(DISTINCT label) AS INT) AS classes FROM d GROUP BY 1",
    "first_images": _B + "SELECT image_id, det_idx FROM d WHERE image_id IN (SELECT image_id FROM img ORDER BY image_id LIMIT 56)",
    "prompt_override": "SELECT DISTINCT id, 'Name the nearest bench.' AS question, answer FROM qa_rows WHERE question_type = 'ClosestBench'",
    "unknown_labels": _B + f"SELECT label, count(*) AS n FROM d WHERE NOT list_contains({_NAMES}, label) GROUP BY 1",
    "category_ids": _B + f"SELECT label, count(*) AS n, CASE WHEN list_contains({_NAMES}, label) THEN CAST(list_position({_NAMES}, label) - 1 AS INT) END AS category_id, CASE WHEN list_contains({_NAMES}, label) THEN label ELSE 'undefined' END AS category FROM d WHERE (x2 - x1) * (y2 - y1) > 500 GROUP BY label",
}
