"""Frequency of every distinct term or value (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE_RECORDS = 3
COMMON_SHARE = {"gold_answer": 0.05, "top_answers": 0.20}


def term_frequencies(records: DataFrame, keys: list[str], terms: str, *, rare: int = RARE_RECORDS, common: float = 0.05) -> DataFrame:
    """(term, occurrences, records, mark) over ``records``, one row per distinct ``keys`` with an ARRAY<STRING> column ``terms``.

    The terms of each record are counted where the record lies: ``records`` comes out of an
    aggregation by ``keys``, so counting by keys and term needs no further shuffle. The sums by term
    are combined by hash on the map side. ``mark`` is too_rare below ``rare`` records, else
    too_common above the share ``common`` of all records, else null. Records with a null or empty
    array count as records; null terms count for nothing.
    """
    total = records.agg(F.count(F.lit(1)).alias("_all"))
    flat = records.select(*keys, F.explode(terms).alias("term")).where("term is not null")
    per = flat.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") < rare, "too_rare").when(F.col("records") > F.col("_all") * common, "too_common")
    return sums.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))  # one row


def gold_records(predictions: DataFrame) -> DataFrame:
    """(pred_id, terms): a row per distinct pred_id (null is one too); terms are maximal runs of letters and digits in lower case.

    Repeated deliveries keep the row scored last.
    """
    last = predictions.groupBy("pred_id").agg(F.max_by("gold_answer", F.struct("scored_at", "gold_answer")).alias("text"))
    return last.select("pred_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)).alias("terms"))


def answer_records(stats: DataFrame) -> DataFrame:
    """(snapshot_id, question_type, computed_at, terms): terms are whole answers in lower case, trimmed, white space runs made one blank."""
    keys = ["snapshot_id", "question_type", "computed_at"]
    one = stats.groupBy(*keys).agg(F.max("top_answers").alias("top_answers"))
    clean = F.transform("top_answers", lambda a: F.trim(F.regexp_replace(F.lower(a["answer"]), r"[\s\p{Z}]+", " ")))
    return one.select(*keys, clean.alias("terms"))


def marked_terms(predictions: DataFrame, stats: DataFrame) -> DataFrame:
    """(field, term, mark) of all terms of both fields that are too rare or too common."""
    return frequency_report(predictions, stats).where("mark is not null").select("field", "term", "mark")


def frequency_report(predictions: DataFrame, stats: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, mark) of all terms of gold_answer and top_answers."""
    gold = term_frequencies(gold_records(predictions), ["pred_id"], "terms", common=COMMON_SHARE["gold_answer"]).select(F.lit("gold_answer").alias("field"), "*")
    top = term_frequencies(answer_records(stats), ["snapshot_id", "question_type", "computed_at"], "terms", common=COMMON_SHARE["top_answers"]).select(F.lit("top_answers").alias("field"), "*")
    return gold.unionByName(top)
