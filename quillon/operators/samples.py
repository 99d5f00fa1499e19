"""Samples of benchmarks from their records: yes/no captions, caption choices, letters, points and chat turns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import prompts as P
from quillon.functions import text as T
from quillon.operators import chat
from quillon.operators.ordered import dense_position, unit_hash

# Where records, captions and image paths may be found in a record, first match wins.
RECORD_KEYS = ["data", "examples", "samples", "annotations"]
CAPTION_KEYS = ["caption_options", "captions", "text_options", "options"]
IMAGE_KEYS = ["image_path", "image", "filepath", "file_path"]
GROUP_KEYS = ["group_id", "set_id", "pair_id", "source_id"]


def json_records(rows: DataFrame, column: str = "value") -> DataFrame:
    """(pos, record VARIANT) of JSON texts: the items of a list, or of the first list under RECORD_KEYS.

    Texts that are no JSON, or hold no such list, are an error when the rows are read.
    """
    v = F.try_parse_json(column)
    whole = F.try_variant_get(v, "$", "array<variant>")
    found = F.coalesce(whole, *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in RECORD_KEYS], F.raise_error(F.lit("no list of records")).cast("array<variant>"))
    return rows.select(F.posexplode(found).alias("pos", "record"))


def first_of(record: Column, keys: list[str], kind: str) -> Column:
    """The first of ``keys`` that a record VARIANT has with something in it; none is an error when it is read."""
    def filled(k: str) -> Column:
        x = F.try_variant_get(record, f"$.{k}", kind)
        return F.when(F.size(x) > 0, x) if kind.startswith("array") else F.nullif(x, F.lit(""))

    return F.coalesce(*[filled(k) for k in keys], F.raise_error(F.concat(F.lit("none of " + ", ".join(keys) + " in "), F.to_json(record))).cast(kind))


def limited(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def vsr_samples(rows: DataFrame, split: str, *, limit: int | None = None) -> DataFrame:
    """(dataset, split, sample_id, question, gold_answer, caption, relation, subject, object) of rows (row_index, id, caption, label, relation, subj, obj, image).

    Rows without an image are skipped; the limit counts the rest. Label 1 is yes, all else no.
    """
    kept = limited(rows.where("image is not null"), ["row_index"], limit)
    sid = F.coalesce(F.col("id").cast("string"), F.concat_ws("_", F.lit(split), F.col("row_index").cast("string")))
    text = lambda c: F.coalesce(c, F.lit(""))
    return kept.select(
        F.lit("vsr").alias("dataset"), F.lit(split).alias("split"), sid.alias("sample_id"), P.caption_question(F.col("caption")).alias("question"), F.when(F.col("label") == 1, "yes").otherwise("no").alias("gold_answer"),
        "caption", F.coalesce("relation", F.lit("unknown")).alias("relation"), text("subj").alias("subject"), text("obj").alias("object"),
    )


def group_key(subset: Column, ids: list[Column], path: Column, index: Column) -> Column:
    """The group of a caption choice: by the first id there is, else by the parts of the file's name, else by its folder, else by fours."""
    name = F.substring_index(path, "/", -1)
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    parts = F.split(stem, "_")
    folder = F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.lit(""))
    by_parts = F.when(F.size(parts) >= 3, F.concat_ws(":", subset, F.element_at(parts, 1), F.element_at(parts, -1)))
    by_folder = F.when(folder.isNotNull(), F.concat_ws(":", subset, folder, F.element_at(parts, 1)))
    by_id = F.coalesce(*[F.when(i.isNotNull(), F.concat_ws(":", subset, i.cast("string"))) for i in ids]) if ids else F.lit(None).cast("string")
    return F.coalesce(by_id, by_parts, by_folder, F.concat_ws(":", subset, F.lit("idx_group"), F.floor(index / 4).cast("string")))


def whatsup_samples(records: DataFrame, *, limit: int | None = None, seed: int = 0) -> DataFrame:
    """(sample_id, subset, question, gold_answer, gold_caption, gold_preposition, group_key, options) of records (subset, idx, id, image_path, options, group_id).

    The first option is right. Options are shown in the order of a hash of seed, record and place; records
    with fewer than two are skipped.
    """
    c = F.col
    shown = F.array_sort(F.transform("options", lambda o, i: F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), c("subset"), c("idx").cast("string"), c("image_path"), i.cast("string"))).alias("h"), i.alias("i"), o.alias("o"))))
    rows = limited(records.where(F.size("options") >= 2), ["subset", "idx"], limit).withColumn("_shown", shown)
    options = F.transform("_shown", lambda x: x["o"])
    gold = F.array_position(F.transform("_shown", lambda x: x["i"]), 0) - 1
    return rows.select(
        F.coalesce(c("id").cast("string"), F.concat_ws("_", "subset", c("idx").cast("string"))).alias("sample_id"), "subset", P.choice_question(options).alias("question"), P.letter_of(gold.cast("int")).alias("gold_answer"),
        c("options")[0].alias("gold_caption"), T.preposition(c("options")[0]).alias("gold_preposition"), group_key(c("subset"), [c("group_id")], c("image_path"), c("idx")).alias("group_key"), options.alias("options"),
    )


def options_of(metadata: Column) -> Column:
    """The options in a JSON list, none for null, empty or bad JSON."""
    return F.coalesce(F.from_json(metadata, "array<string>"), F.array().cast("array<string>"))


def erqa_samples(rows: DataFrame, *, limit: int | None = None, separate: int = 4) -> DataFrame:
    """(sample_id, question, gold_answer, answer_format, question_type, image_count, input_mode) of rows (row_index, question_id, question, answer, question_type, images)."""
    n = F.size("images")
    return limited(rows.where(n > 0), ["row_index"], limit).select(
        F.coalesce(F.col("question_id").cast("string"), F.concat(F.lit("erqa_"), F.col("row_index").cast("string"))).alias("sample_id"), P.eval_question("erqa", F.lit("letter"), F.col("question")).alias("question"),
        F.substring(F.upper(F.trim("answer")), 1, 1).alias("gold_answer"), F.lit("letter").alias("answer_format"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"),
        n.alias("image_count"), F.when(n > separate, "contact_sheet").otherwise("separate_images").alias("input_mode"),
    )


def robospatial_samples(rows: DataFrame, split: str, *, limit: int | None = None) -> DataFrame:
    """(sample_id, question, gold_answer, answer_format, category, has_mask) of rows (row_index, question, answer, category, mask): points in a context, else yes or no."""
    category = F.coalesce("category", F.lit(split))
    form = F.when(category == "context", "points").otherwise("yes_no")
    return limited(rows, ["row_index"], limit).select(
        F.concat_ws("_", F.lit(split), F.col("row_index").cast("string")).alias("sample_id"), P.eval_question("robospatial", form, F.col("question")).alias("question"), F.trim("answer").alias("gold_answer"),
        form.alias("answer_format"), category.alias("category"), ((category == "context") & F.col("mask").isNotNull()).cast("int").alias("has_mask"),
    )


def openspaces_examples(turns: DataFrame, *, eval_fraction: float = 0.1, seed: int = 42, max_question: int = 1024, max_answer: int = 512, limits: dict[str, int] | None = None) -> DataFrame:
    """(split, conv_id, turn, question, answer, question_type, answer_type): the pairs of chat turns, conversations divided by the rank of their hash.

    Longer questions and answers are left out; ``limits`` keeps the first pairs of a split by conversation and turn.
    """
    pairs = chat.qa_pairs(turns).where((F.length("question") <= max_question) & (F.length("answer") <= max_answer))
    convs = dense_position(turns.select("conv_id").distinct().withColumn("_h", unit_hash("conv_id", seed=seed)), ["_h", "conv_id"], "_k")
    total = F.broadcast(convs.agg(F.count(F.lit(1)).alias("_all")))  # one row
    held = F.greatest(F.lit(1), F.rint(F.col("_all") * eval_fraction)) if eval_fraction > 0 else F.lit(0)
    sides = convs.crossJoin(total).select("conv_id", F.when(F.col("_k") < held, "evaluation").otherwise("train").alias("split"))
    rows = pairs.join(sides, "conv_id").select("split", "conv_id", "turn", "question", "answer", T.question_kind(F.col("question"), F.col("answer")).alias("question_type"), T.answer_kind(F.col("answer")).alias("answer_type"))
    for split, most in (limits or {}).items():
        rows = rows.where(F.col("split") != split).unionByName(rows.where(F.col("split") == split).orderBy("conv_id", "turn").limit(most))
    return rows


def content_text(content: Column) -> Column:
    """The text of a chat message's content (VARIANT): a text, the first filled one of text, value and content, or the items of a list joined."""
    one = lambda v: F.coalesce(*[F.nullif(T.strip(F.try_variant_get(v, p, "string")), F.lit("")) for p in ("$.text", "$.value", "$.content", "$.text.value", "$.content.text")])
    kind = F.schema_of_variant(content)
    items = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(one(v), F.lit(""))).otherwise(T.strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))))
    joined = F.array_join(F.filter(items, lambda x: x != ""), " ")
    return F.coalesce(F.when(kind.startswith("ARRAY"), joined).when(kind.startswith("OBJECT"), one(content)).otherwise(T.strip(F.try_variant_get(content, "$", "string"))), F.lit(""))


def chat_turns(rows: DataFrame, key: str, messages: str) -> DataFrame:
    """(conv_id, turn, role, text) of JSON lists of messages; bad JSON and items that are no objects give none. Human and gpt or model are user and assistant."""
    items = F.try_variant_get(F.try_parse_json(messages), "$", "array<variant>")
    flat = rows.select(F.col(key).alias("conv_id"), F.posexplode(items).alias("turn", "m")).where(F.schema_of_variant("m").startswith("OBJECT"))
    role = F.lower(F.coalesce(F.try_variant_get("m", "$.role", "string"), F.lit("")))
    plain = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "gpt", "model"), "assistant").otherwise(role)
    content = F.coalesce(F.try_variant_get("m", "$.content", "variant"), F.try_variant_get("m", "$.text", "variant"))
    return flat.select("conv_id", F.col("turn").cast("bigint").alias("turn"), plain.alias("role"), content_text(content).alias("text"))


def first_image(images: Column) -> Column:
    """The first of an array of images (bytes, path), an error for an empty one when it is read."""
    return F.when(F.size(images) > 0, images[0]).otherwise(F.raise_error(F.lit("no image")).cast("struct<bytes:binary,path:string>"))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides by their place in their orders, as far as the shorter one goes."""
    return dense_position(left, left_order, "_k").join(dense_position(right, right_order, "_k"), "_k").drop("_k")


def yes_no_gold(answer: Column) -> Column:
    """The gold answer as yes or no, an error if it is neither when it is read."""
    return F.coalesce(T.yes_no(answer)["value"], F.raise_error(F.concat(F.lit("neither yes nor no: "), F.coalesce(answer, F.lit("null")))).cast("string"))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scored_points(rows: DataFrame, *, threshold: int = 128, most: int = 10) -> DataFrame:
    """(id, parse_method, n_points, first_correct, any_correct, valid_fraction) of rows (id, said, gold, mask, width, height), mask being grey bytes.

    The gold points say whether the bright or the dark part of the mask is meant, by majority. Without a mask nothing is correct.
    """

    def score(batches):
        for b in batches:
            out = []
            for i, said, gold, mask, w, h in zip(b["id"], b["said"], b["gold"], b["mask"], b["width"], b["height"]):
                hits: list[bool] = []
                if mask is not None and len(mask) == w * h:
                    at = lambda p: mask[min(max(round(p["y"] * (h - 1)), 0), h - 1) * w + min(max(round(p["x"] * (w - 1)), 0), w - 1)] >= threshold
                    bright = not len(gold) or np.mean([at(p) for p in gold]) >= 0.5
                    hits = [at(p) == bright for p in said]
                out.append((i, len(said), int(bool(hits) and hits[0]), int(any(hits)), float(np.mean(hits)) if hits else 0.0))
            yield pd.DataFrame(out, columns=["id", "n_points", "first_correct", "any_correct", "valid_fraction"])

    parsed = rows.select("id", T.points(F.col("said"), most).alias("s"), T.points(F.col("gold"), 100)["points"].alias("gold"), "mask", "width", "height")
    scored = parsed.select("id", F.col("s.points").alias("said"), "gold", "mask", "width", "height").mapInPandas(score, "id bigint, n_points int, first_correct int, any_correct int, valid_fraction double")
    return scored.join(parsed.select("id", F.col("s.method").alias("parse_method")), "id")


def one_of_each(rows: DataFrame, group: list[str], key: str, seed: int = 0) -> DataFrame:
    """One row of each group, drawn by hash."""
    cols = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*cols), F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key))).alias("_r")).select(*group, "_r.*")


def topped_up(stored: DataFrame, pool: DataFrame, group: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """(group, key, stored): the first ``size`` stored keys of each group by key, and drawn ones from ``pool`` for what is missing."""
    w = Window.partitionBy(group)
    kept = stored.select(group, key).distinct().withColumn("_k", F.row_number().over(w.orderBy(key))).where(F.col("_k") <= size).drop("_k")
    have = kept.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rest = pool.select(group, key).distinct().join(stored.select(group, key).distinct(), [group, key], "left_anti")
    drawn = rest.withColumn("_k", F.row_number().over(w.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key))).join(have, group, "left")
    drawn = drawn.where(F.col("_k") <= size - F.coalesce("_n", F.lit(0))).select(group, key)
    return kept.withColumn("stored", F.lit(True)).unionByName(drawn.withColumn("stored", F.lit(False)))


def by_image(rows: DataFrame, image: str, table: str, columns: list[str]) -> DataFrame:
    """(image, table, rows): the rows of each image and table together, in the order of their columns."""
    return rows.groupBy(image, table).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
