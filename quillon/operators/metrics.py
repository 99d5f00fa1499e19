"""Accuracy metrics and dataset statistics as long tables (metric, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.names import plain_key, plain_split, scene_name
from quillon.operators.ordered import dense_position

# Question types kept out of training.
HELD_OUT = ["CountPersonAtClosestBench", "ClosestBenchWithPerson", "AvoidObstacleToReachClosestBench", "AvoidObstacleToReachClosestStopSign", "DirectionToClosestBench", "DirectionToClosestStopSign"]


def once(predictions: DataFrame) -> DataFrame:
    """Each pred_id once, as scored last."""
    cols = [c for c in predictions.columns if c != "pred_id"]
    last = F.max_by(F.struct(*cols), F.struct("scored_at", "raw_prediction"))
    return predictions.where("pred_id is not null").groupBy("pred_id").agg(last.alias("r")).select("pred_id", "r.*")


def plain_type(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, r"[^A-Za-z0-9]", ""))


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def grouped_accuracy(rows: DataFrame, key: Column, correct: Column | None = None) -> DataFrame:
    """(key, n, accuracy); a missing key is 'unknown'."""
    right = (F.col("is_correct") if correct is None else correct).cast("double")
    return rows.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"), _mean(right).alias("accuracy"))


def seen_unseen(rows: DataFrame) -> DataFrame:
    """(metric, value): accuracy over all, over trained and over held-out question types; 0 where there are none."""
    held = plain_type(F.col("question_type")).isin(*[h.lower() for h in HELD_OUT])
    c = F.col("is_correct").cast("double")
    one = rows.agg(_mean(c).alias("overall"), _mean(F.when(~F.coalesce(held, F.lit(False)), c)).alias("seen"), _mean(F.when(held, c)).alias("unseen"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(f"{m}_accuracy").alias("metric"), F.col(m).alias("value")) for m in ("overall", "seen", "unseen")])).alias("e")).select("e.*")


def macro_accuracy(rows: DataFrame) -> DataFrame:
    """(metric, value): strict and relaxed accuracy, micro and macro over question type and answer kind."""
    base = rows.select(F.coalesce(plain_type(F.col("question_type")), F.lit("unknown")).alias("question_type"), T.answer_kind(F.col("gold_answer")).alias("answer_type"), F.col("is_correct").cast("double").alias("strict"), T.relaxed_correct(F.col("gold_answer"), F.col("raw_prediction")).cast("double").alias("relaxed"))
    sets = base.groupingSets([[], ["question_type"], ["answer_type"]], "question_type", "answer_type").agg(F.grouping_id().alias("g"), F.avg("strict").alias("strict"), F.avg("relaxed").alias("relaxed"))
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "macro_question_type").otherwise("macro_answer_type")
    means = sets.groupBy(level.alias("level")).agg(F.avg("strict").alias("strict"), F.avg("relaxed").alias("relaxed"))
    return means.select(F.explode(F.array(*[F.struct(F.concat_ws("_", "level", F.lit(k)).alias("metric"), F.col(k).alias("value")) for k in ("strict", "relaxed")])).alias("e")).select("e.*")


def confusion(rows: DataFrame, gold: Column, said: Column) -> DataFrame:
    """(gold, predicted, n), sparse."""
    return rows.groupBy(F.coalesce(gold, F.lit("unknown")).alias("gold"), F.coalesce(said, F.lit("unknown")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def pair_set_accuracy(rows: DataFrame) -> DataFrame:
    """(metric, value, n) of rows (group_key, preposition, is_correct): pairs of opposite prepositions and whole groups that are right in all rows.

    A pair counts from 2 rows, a group from 4; null where none counts.
    """
    pairs = rows.withColumn("pair", T.preposition_pair(F.col("preposition"))).where("pair is not null")
    p = pairs.groupBy("group_key", "pair").agg(F.count(F.lit(1)).alias("n"), F.min("is_correct").alias("ok")).where("n >= 2").agg(F.avg(F.col("ok").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    g = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("is_correct").alias("ok")).where("n >= 4").agg(F.avg(F.col("ok").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))
    return p.select(F.lit("pair_accuracy").alias("metric"), "value", "n").union(g.select(F.lit("set_accuracy"), "value", "n"))


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, delta) over the keys in both."""
    b, a = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    return b.join(a, keys).select(*keys, "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def qa_once(qa: DataFrame) -> DataFrame:
    """(id, question_type, scene, split, answer): each id once, as ingested last, with the plain forms of type, scene and split."""
    last = F.max_by(F.struct("question_type", "source_id", "split", "answer"), F.struct("ingested_at", "question_type", "source_id", "split", "answer"))
    r = qa.where("id is not null").groupBy("id").agg(last.alias("r"))
    return r.select("id", plain_key(F.col("r.question_type")).alias("question_type"), scene_name(F.col("r.source_id")).alias("scene"), plain_split(F.col("r.split")).alias("split"), "r.answer")


SPLITS = ("train", "evaluation", "test")


def dataset_stats(qa: DataFrame) -> DataFrame:
    """(question_type, qa_pairs, images, share, train, evaluation, test, train_images, evaluation_images, test_images) per plain type, and over all ('*').

    Images are distinct scenes, whatever their spelling. Rows without a type count over all only.
    """
    rows = qa_once(qa).select("question_type", "scene", "split")
    # One row per type, scene and split; what is counted distinctly is counted on these.
    per = rows.groupBy("question_type", "scene", "split").agg(F.count(F.lit(1)).alias("n"))
    split = lambda s: F.col("split") == s

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        scenes = df.where("scene is not null").groupBy(*keys, "scene").agg(*[F.max(split(s).cast("int")).alias(s) for s in SPLITS]).groupBy(*keys).agg(F.count(F.lit(1)).alias("images"), *[F.sum(F.coalesce(s, F.lit(0))).alias(f"{s}_images") for s in SPLITS])
        pairs = df.groupBy(*keys).agg(F.sum("n").alias("qa_pairs"), *[F.coalesce(F.sum(F.when(split(s), F.col("n"))), F.lit(0)).alias(s) for s in SPLITS])
        return pairs.join(scenes, keys, "left") if keys else pairs.crossJoin(F.broadcast(scenes))  # one row each

    cols = ["question_type", "qa_pairs", "images", *SPLITS, *[f"{s}_images" for s in SPLITS]]
    every = level(per, []).withColumn("question_type", F.lit("*")).select(*cols)
    both = level(per.where("question_type is not null"), ["question_type"]).select(*cols).unionByName(every)
    total = F.broadcast(every.select(F.col("qa_pairs").alias("_all")))  # one row
    counts = {c: F.coalesce(c, F.lit(0)) for c in cols[2:]}
    return both.withColumns(counts).crossJoin(total).withColumn("share", F.col("qa_pairs") / F.col("_all")).drop("_all")


def top_answers(qa: DataFrame, most: int = 10, buckets: int = 64) -> DataFrame:
    """(question_type, answer, n, rank): the most frequent answers of each plain type; ties by first id, then answer.

    The best of each bucket of answers are found first, so that no task ranks all answers of a type.
    """
    counts = qa_once(qa).where("question_type is not null").groupBy("question_type", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    order = [F.desc("n"), "first", "answer"]
    some = counts.withColumn("_b", F.pmod(F.xxhash64("answer"), F.lit(buckets))).withColumn("rank", F.row_number().over(Window.partitionBy("question_type", "_b").orderBy(*order))).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("question_type").orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select("question_type", "answer", "n", "rank")


def answer_distribution(rows: DataFrame, answer: Column) -> DataFrame:
    """(answer, n, position): numbers first by value, then the rest by text."""
    counts = rows.groupBy(answer.alias("answer")).agg(F.count(F.lit(1)).alias("n")).where("answer is not null")
    number = F.when(F.col("answer").rlike("^[0-9]{1,9}$"), F.col("answer").try_cast("int")).otherwise(999)
    placed = dense_position(counts.withColumn("_number", number), ["_number", "answer"], "position")
    return placed.select("answer", "n", (F.col("position") + 1).alias("position"))


def equalized_mean(rows: DataFrame, group: str, key: str, score: str, most: int) -> DataFrame:
    """(per_group, value): every group cut to as many rows as the smallest has (at most ``most``), by hash; mean of the group means.

    A group's rows are ranked by buckets of their hash, each shifted by the counts of the buckets before it.
    """
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    per = hashed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))  # at most 4,096 rows a group
    least = F.broadcast(per.groupBy(group).agg(F.sum("_n").alias("c")).agg(F.least(F.min("c"), F.lit(most)).alias("m")))  # one row
    inner = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key)))
    ranked = inner.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bb"))).crossJoin(least)
    kept = ranked.where(F.col("_r") + F.col("_n0") <= F.col("m"))
    return kept.groupBy(group, "m").agg(F.avg(score).alias("v")).groupBy(F.col("m").alias("per_group")).agg(F.avg("v").alias("value"))
