"""Text, metric, statistics, loader and log queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import geo
from quillon.functions import text as T
from quillon.operators import chat, metrics
from quillon.operators.ordered import dense_position
from quillon.operators.scenes import boxes, class_counts
from quillon.sources import table

C = F.col


def _p(spark, d) -> DataFrame:
    return metrics.once(table(spark, d, "predictions"))


def _qa(spark, d) -> DataFrame:
    return table(spark, d, "qa_rows")


def _det(spark, d) -> DataFrame:
    return boxes(table(spark, d, "detections"))


def parse_yes_no(spark, d):
    return _p(spark, d).select("pred_id", T.yes_no(C("raw_prediction")).alias("r")).select("pred_id", "r.*")


def confusion(spark, d):
    return metrics.confusion(_p(spark, d), C("gold_normalized"), C("normalized_prediction"))


def pair_set_accuracy(spark, d):
    rows = _p(spark, d).select(C("source_id").alias("group_key"), T.preposition(F.coalesce("question", F.lit(""))).alias("preposition"), "is_correct")
    return metrics.pair_set_accuracy(rows)


def delta(spark, d):
    rows = _p(spark, d).withColumn("question_type", F.coalesce(metrics.plain_type(C("question_type")), F.lit("unknown")))
    per = rows.groupBy("model_family", "question_type", "phase").agg(F.avg(C("is_correct").cast("double")).alias("value"))
    return metrics.delta(per.where("phase = 'before_finetune'").drop("phase"), per.where("phase = 'after_finetune'").drop("phase"), ["model_family", "question_type"])


def leakage_guard(spark, d):
    """Held-out question types in train, under any spelling; must be empty for a clean dataset (``evaluation.guard_no_leak`` raises)."""
    rows = metrics.qa_once(_qa(spark, d)).where((C("split") == "train") & C("question_type").isin(*[h.lower() for h in metrics.HELD_OUT]))
    return rows.groupBy("question_type").agg(F.count(F.lit(1)).alias("rows"))


def dedup_hash(spark, d):
    """One row per picture by the first 16 digits of its SHA-256, with the first id that has it."""
    rows = _qa(spark, d).select("id", C("image.bytes").alias("bytes")).where("bytes is not null")
    return rows.groupBy(F.substring(F.sha2("bytes", 256), 1, 16).alias("hash")).agg(F.min("id").alias("id"), F.count_distinct("id").alias("rows"))


def last_event_per_run(spark, d):
    rows = table(spark, d, "events").where("event_type = 'purchase'")
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.*")


def time_of_day_filter(spark, d):
    return table(spark, d, "events").where((F.hour("ts") >= 8) & (F.hour("ts") < 18)).groupBy("event_type", F.hour("ts").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def scene_filter(spark, d):
    """Scenes by day in fair weather, numbered densely; unknown weather is fair."""
    kept = table(spark, d, "scenes").where((F.lower(F.trim("timeofday")) == "daytime") & ~F.coalesce(F.lower(F.trim("weather")), F.lit("")).isin("foggy", "snowy", "rainy"))
    return dense_position(kept.select("image_id", "source_id"), ["image_id"], "idx")


def image_box_join(spark, d):
    det = table(spark, d, "detections").distinct()
    keys = ["image_id", "img_w", "img_h"]
    return table(spark, d, "scenes").join(det.select(*keys, "score"), keys).groupBy("image_id", "source_id").agg(F.count(F.lit(1)).alias("boxes"), F.max("score").alias("best_score"))


def iou_pairs(spark, d):
    det = _det(spark, d)
    b = ["det_idx", "x1", "y1", "x2", "y2"]
    pairs = det.select("image_id", F.struct(*b).alias("a")).join(det.select("image_id", F.struct(*b).alias("b")), "image_id").where("a.det_idx < b.det_idx")
    return pairs.where(geo.intersection(C("a"), C("b")) > 0).select("image_id", C("a.det_idx").alias("a_idx"), C("b.det_idx").alias("b_idx"), geo.iou(C("a"), C("b")).alias("iou"))


def bbox_edge_dist(spark, d):
    det = _det(spark, d)
    b = ["x1", "y1", "x2", "y2"]
    clock = det.where("label = 'clock'").groupBy("image_id").agg(F.min_by(F.struct(*b), "det_idx").alias("c"))
    return det.where("label <> 'clock'").select("image_id", "det_idx", F.struct(*b).alias("b")).join(clock, "image_id").select("image_id", "det_idx", geo.gap_between(C("b"), C("c")).alias("gap"))


def best_frame(spark, d):
    """The frame of each file (ten images) with the best mix of many and large boxes; the first of equal ones."""
    per = _det(spark, d).groupBy(F.floor(C("image_id") / 10).alias("file"), "image_id").agg(F.count(F.lit(1)).alias("n"), F.avg((C("x2") - C("x1")) * (C("y2") - C("y1"))).alias("a"))
    w = Window.partitionBy("file")
    scored = per.withColumn("score", 0.5 * (C("n") / F.max("n").over(w) + C("a") / F.max("a").over(w)))
    best = F.max_by(F.struct("image_id", "score"), F.struct("score", -C("image_id")))
    return scored.groupBy("file").agg(best.alias("b")).select("file", "b.*")


def qa_pairs_from_turns(spark, d):
    p = table(spark, d, "predictions")
    turn = lambda n, role, text: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), C(text).alias("text"))
    turns = p.select(C("pred_id").alias("conv_id"), F.explode(F.array(turn(1, "user", "question"), F.when(C("is_correct") == 0, turn(2, "user", "gold_answer")), turn(3, "assistant", "raw_prediction"), turn(4, "assistant", "normalized_prediction"))).alias("t")).where("t is not null").select("conv_id", "t.*").distinct()
    return chat.qa_pairs(turns)


QUERIES = {
    "normalize_answer": lambda s, d: _p(s, d).select("pred_id", T.normalize_answer(C("raw_prediction")).alias("value")),
    "parse_yes_no": parse_yes_no,
    "parse_int": lambda s, d: _p(s, d).select("pred_id", T.reply_int(C("raw_prediction")).alias("value")),
    "parse_id_list": lambda s, d: _p(s, d).select("pred_id", F.array_join(T.reply_ids(C("raw_prediction")), ", ").alias("value")),
    "parse_action": lambda s, d: _p(s, d).select("pred_id", T.reply_action(C("raw_prediction")).alias("action"), T.reply_turn(C("raw_prediction")).alias("turn")),
    "parse_direction": lambda s, d: _p(s, d).select("pred_id", T.reply_compass(C("raw_prediction")).alias("compass"), T.reply_egocentric(C("raw_prediction")).alias("egocentric")),
    "polarity_and_metres": lambda s, d: _p(s, d).select("pred_id", T.polarity(C("raw_prediction")).alias("polarity"), T.metres(C("raw_prediction")).alias("metres"), F.array_join(T.direction_set(C("raw_prediction")), ",").alias("directions")),
    "relaxed_correct": lambda s, d: _p(s, d).select("pred_id", T.relaxed_correct(C("gold_answer"), C("raw_prediction")).alias("relaxed")),
    "classify_question": lambda s, d: _p(s, d).select("pred_id", T.question_kind(C("question"), C("gold_answer")).alias("question_kind"), T.answer_kind(C("gold_answer")).alias("answer_kind"), T.preposition(F.coalesce("question", F.lit(""))).alias("preposition")),
    "accuracy_by_type": lambda s, d: metrics.grouped_accuracy(_p(s, d), metrics.plain_type(C("question_type"))),
    "seen_unseen": lambda s, d: metrics.seen_unseen(_p(s, d)),
    "macro_accuracy": lambda s, d: metrics.macro_accuracy(_p(s, d)),
    "pair_set_accuracy": pair_set_accuracy,
    "confusion": confusion,
    "delta": delta,
    "equalized_sample": lambda s, d: metrics.equalized_mean(_p(s, d), "run_name", "pred_id", "is_correct", 300),
    "dataset_stats": lambda s, d: metrics.dataset_stats(_qa(s, d)),
    "top_answers": lambda s, d: metrics.top_answers(_qa(s, d)),
    "answer_distribution": lambda s, d: metrics.answer_distribution(_qa(s, d), C("answer")),
    "leakage_guard": leakage_guard,
    "dedup_hash": dedup_hash,
    "last_event_per_run": last_event_per_run,
    "time_of_day_filter": time_of_day_filter,
    "scene_filter": scene_filter,
    "image_box_join": image_box_join,
    "class_counts": lambda s, d: class_counts(_det(s, d)),
    "iou_pairs": iou_pairs,
    "bbox_edge_dist": bbox_edge_dist,
    "best_frame": best_frame,
    "qa_pairs_from_turns": qa_pairs_from_turns,
}
