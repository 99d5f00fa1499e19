"""Metric reports of benchmarks and runs as long tables (metric, key, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.boxes import count_bucket
from quillon.operators import metrics as M



def _rows(df: DataFrame, metric: str, key: Column | None, value: Column) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), (F.lit("") if key is None else key).cast("string").alias("key"), value.cast("double").alias("value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _report(rows: DataFrame, keys: dict[str, Column], counts: dict[str, Column], failed: Column) -> list[DataFrame]:
    """Totals; per ``keys`` accuracy, its unweighted mean and counts; per ``counts`` a distribution."""
    right = F.col("is_correct").cast("double")
    one = rows.agg(F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.sum("is_correct"), F.lit(0)).alias("num_correct"), M._mean(right).alias("overall_accuracy"), M._mean(failed.cast("double")).alias("parse_failure_rate"))
    parts = [_rows(one, m, None, F.col(m)) for m in ("num_samples", "num_correct", "overall_accuracy", "parse_failure_rate")]
    for name, key in keys.items():
        per = M.grouped_accuracy(rows, key)
        parts += [_rows(per, f"{name}_accuracy", F.col("key"), F.col("accuracy")), _rows(per, f"{name}_counts", F.col("key"), F.col("n")), _rows(per.agg(M._mean(F.col("accuracy")).alias("a")), f"{name}_macro_accuracy", None, F.col("a"))]
    for name, key in counts.items():
        per = rows.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_rows(per, name, F.col("key"), F.col("n")))
    return parts


def _unparsed() -> Column:
    return F.coalesce(F.col("parsed_prediction"), F.lit("")) == ""


def vsr_metrics(rows: DataFrame) -> DataFrame:
    """(metric, key, value) of rows (gold_answer, relation, parsed_prediction, is_correct)."""
    c = F.col
    return _union(_report(rows, {"relation": c("relation"), "label": c("gold_answer")}, {"gold_distribution": c("gold_answer"), "prediction_distribution": c("parsed_prediction")}, _unparsed()))


def whatsup_metrics(rows: DataFrame) -> DataFrame:
    """(metric, key, value) of rows (subset, gold_preposition, predicted_preposition, group_key, parsed_prediction, is_correct); pairs and sets are null where none counts."""
    c = F.col
    parts = _report(rows, {"subset": c("subset"), "preposition": c("gold_preposition")}, {"prediction_distribution": c("parsed_prediction")}, _unparsed())
    wrong = M.confusion(rows, c("gold_preposition"), c("predicted_preposition"))
    sets = M.pair_set_accuracy(rows.select("group_key", c("gold_preposition").alias("preposition"), "is_correct"))
    counts = sets.select(F.replace("metric", F.lit("accuracy"), F.lit("count")).alias("metric"), F.lit("").alias("key"), c("n").cast("double").alias("value"))
    return _union([*parts, _rows(wrong, "confusion_matrix", F.concat_ws("/", "gold", "predicted"), c("n")), sets.select("metric", F.lit("").alias("key"), "value"), counts])


def erqa_metrics(rows: DataFrame) -> DataFrame:
    """(metric, key, value) of rows (question_type, gold_answer, parsed_prediction, image_count, is_correct)."""
    c = F.col
    return _union(_report(rows, {"question_type": c("question_type"), "image_count": count_bucket(F.coalesce("image_count", F.lit(1)))}, {"answer_distribution": c("gold_answer"), "prediction_distribution": c("parsed_prediction")}, _unparsed()))


def robospatial_metrics(rows: DataFrame) -> DataFrame:
    """(metric, key, value) of rows (category, answer_format, gold_answer, parsed_prediction, parse_method, is_correct, first_point_correct, any_point_correct, valid_point_fraction).

    Metrics of an empty part (yes/no or points) are null.
    """
    c = F.col
    failed = _unparsed() | (c("parse_method") == "unparsed")
    binary, context = c("answer_format") == "yes_no", c("answer_format") == "points"
    part = lambda when, x: F.avg(F.when(when, x.cast("double")))
    one = rows.agg(
        part(binary, c("is_correct")).alias("binary_accuracy"), part(context, F.coalesce("first_point_correct", F.lit(0))).alias("context_first_point_accuracy"), part(context, F.coalesce("any_point_correct", F.lit(0))).alias("context_any_point_accuracy"),
        part(context, F.coalesce("valid_point_fraction", F.lit(0.0))).alias("context_mean_valid_point_fraction"), part(context, c("parse_method") == "unparsed").alias("context_parse_failure_rate"),
    )
    parts = _report(rows, {"category": c("category")}, {"prediction_distribution": c("parsed_prediction")}, failed)
    parts += [_rows(one, m, None, c(m)) for m in one.columns]
    per = rows.where(binary).groupBy(F.coalesce("gold_answer", F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return _union([*parts, _rows(per, "binary_counts", c("key"), c("n"))])


def flat_metrics(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, value): the numbers and truth values of nested JSON metrics by their path a/b/c; all else is left out."""
    v = F.try_parse_json(payload)
    level = rows.select(key, F.lit("").alias("path"), v.alias("v")).where("v is not null")
    parts = []
    for _ in range(16):  # deeper nesting than that is no metric report
        inner = level.where(F.schema_of_variant("v").startswith("OBJECT"))
        kinds = inner.select(key, "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "x"))
        level = kinds.select(key, F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws("/", "path", "k")).alias("path"), F.col("x").alias("v"))
        kind = F.schema_of_variant("v")
        number = F.when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "STRING"), F.try_variant_get("v", "$", "double"))
        parts.append(level.select(key, "path", number.alias("value")).where("value is not null"))
        if len(parts) >= 4:
            break
    return _union(parts)


def split_summary(examples: DataFrame) -> DataFrame:
    """(split, metric, key, value): pairs, source rows, and counts by question and answer type of ``openspaces_examples``."""
    one = examples.groupBy("split").agg(F.count(F.lit(1)).alias("num_qa_pairs"), F.count_distinct("conv_id").alias("num_source_rows"))
    parts = [one.select("split", F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(m).alias("value")) for m in ("num_qa_pairs", "num_source_rows")]
    for k in ("question_type", "answer_type"):
        parts.append(examples.groupBy("split", F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("value")).select("split", F.lit(f"{k}_counts").alias("metric"), "key", "value"))
    return _union(parts)


def profile(timings: DataFrame) -> DataFrame:
    """(question_type, is_applicable_ms, apply_ms, hit_rate, empty, total_qa) of timings (question_type, is_applicable_sec, apply_sec, applicable, n_qa), a row per image and question.

    The hit rate is the share, in percent, of applicable images with a pair; 0 if none is applicable.
    """
    able = F.col("applicable")
    per = timings.groupBy("question_type").agg(
        F.avg("is_applicable_sec").alias("a"), F.avg(F.when(able, F.col("apply_sec"))).alias("b"), F.count_if(able).alias("n"), F.count_if(able & (F.col("n_qa") == 0)).alias("empty"), F.sum("n_qa").alias("total_qa"),
    )
    return per.select("question_type", (F.col("a") * 1000).alias("is_applicable_ms"), (F.coalesce("b", F.lit(0.0)) * 1000).alias("apply_ms"), (F.coalesce(F.try_divide(F.col("n") - F.col("empty"), F.col("n")), F.lit(0.0)) * 100).alias("hit_rate"), "empty", "total_qa")


def profile_table(timings: DataFrame) -> str:
    """``profile`` as a Markdown table, a row per question type."""
    lines = ["| Question type | is_applicable avg (ms) | apply avg (ms) | hit rate | empty |", "|-|-|-|-|-|"]
    lines += [f"| {r.question_type} | {r.is_applicable_ms:.2f} | {r.apply_ms:.2f} | {r.hit_rate:.1f}% | {r.empty} |" for r in profile(timings).orderBy("question_type").collect()]  # one row per type
    return "\n".join(lines)


def stored_question_counts(store: DataFrame) -> DataFrame:
    """(question_type, questions) of a key/value store (question_type, question, answer), and over all ('total'); empty and not applicable answers don't count."""
    kept = store.where((F.coalesce("question", F.lit("")) != "") & ~F.coalesce("answer", F.lit("")).isin("", "Question not applicable"))
    return kept.rollup("question_type").agg(F.count(F.lit(1)).alias("questions"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("question_type")).alias("question_type"), "questions")


def final_labels(finals: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """(run_dir, test_name, trial, human_success, failure_reason): final rows of trials with blank labels filled and corrections applied.

    A blank label is false if the notes tell of a failure (which become the reason) or the loop failed,
    else true. Notes that only say no or none tell of none. ``corrections`` (run_dir, test_name, trial,
    new_human_success, new_failure_reason) override.
    """
    note = F.nullif(F.trim("notes"), F.lit(""))
    telling = note.isNotNull() & ~F.lower(note).isin("no", "none", "n/a", "-")
    blank = F.col("human_success").isNull()
    success = F.when(~blank, F.col("human_success")).when(telling, False).otherwise(F.coalesce("model_loop_success", F.lit(False)))
    rows = finals.select("run_dir", "test_name", "trial", success.alias("human_success"), F.when(blank & telling, note).otherwise(F.col("failure_reason")).alias("failure_reason"))
    if corrections is None:
        return rows
    keys = ["run_dir", "test_name", "trial"]
    new = corrections.groupBy(*keys).agg(F.max("new_human_success").alias("_s"), F.max("new_failure_reason").alias("_r"))
    return rows.join(new, keys, "left").select(*keys, F.coalesce("_s", "human_success").alias("human_success"), F.coalesce("_r", "failure_reason").alias("failure_reason"))


def trial_summary(trials: DataFrame) -> DataFrame:
    """(test_name, base_successes, base_trials, base_accuracy_pct, finetuned_successes, finetuned_trials, finetuned_accuracy_pct, delta_pct) of trials (test_name, variant, success).

    Percentages of a variant without trials are null.
    """
    aggs = []
    for v in ("base", "finetuned"):
        mine = F.col("variant") == v
        aggs += [F.count_if(mine & F.col("success")).alias(f"{v}_successes"), F.count_if(mine).alias(f"{v}_trials")]
    pct = lambda v: F.try_divide(F.col(f"{v}_successes") * 100.0, F.col(f"{v}_trials"))
    per = trials.groupBy("test_name").agg(*aggs).withColumn("base_accuracy_pct", pct("base")).withColumn("finetuned_accuracy_pct", pct("finetuned"))
    return per.select("test_name", "base_successes", "base_trials", "base_accuracy_pct", "finetuned_successes", "finetuned_trials", "finetuned_accuracy_pct", (F.col("finetuned_accuracy_pct") - F.col("base_accuracy_pct")).alias("delta_pct"))


def reasons(finals: DataFrame) -> DataFrame:
    """(test_name, failure_reason, n)"""
    return finals.groupBy("test_name", F.coalesce("failure_reason", F.lit("")).alias("failure_reason")).agg(F.count(F.lit(1)).alias("n"))


def mean_by_folder(rows: DataFrame, path: Column, score: Column) -> DataFrame:
    """(folder, n, value): the mean score of the files of each folder."""
    return rows.groupBy(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.avg(score.cast("double")).alias("value"))


def with_split(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of several splits with the column ``split``; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("split", F.lit(name)) for name, df in parts.items()])


def guard_no_leak(qa: DataFrame, split: Column) -> DataFrame:
    """``qa``; reading it is an error if a held-out question type is in its train split."""
    held = M.plain_type(F.col("question_type")).isin(*[h.lower() for h in M.HELD_OUT])
    leaked = (split == "train") & held
    return qa.where(F.assert_true(~F.coalesce(leaked, F.lit(False)), F.concat(F.lit("held-out type in train: "), F.coalesce("question_type", F.lit("")))).isNull())


def best_checkpoint(evals: DataFrame, key: str = "run", step: str = "step", value: str = "seen_accuracy") -> DataFrame:
    """The step of each run with the best value, the first of equal ones."""
    return evals.groupBy(key).agg(F.max_by(F.struct(step, value), F.struct(F.col(value), -F.col(step))).alias("b")).select(key, "b.*")


