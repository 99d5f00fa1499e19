"""QA rows from detections: a configured set of questions over one shared frame.

Scene questions are expressions over the arrays of an image, so all of them are worked out in one pass
and exploded once; box questions share the partitioning by image. Rows are numbered densely in the
order of image, question and item.
"""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import box_questions as B
from quillon.operators import scene_questions as S
from quillon.operators import wordings
from quillon.operators.ordered import dense_position
from quillon.operators.scenes import boxes, scenes
from quillon.session import cut, spread

LOG = logging.getLogger(__name__)
SCENE_BY_TYPE = {kind: ask for kind, ask in S.ASKS.values()}
BOX_BY_TYPE = {kind: build for kind, build in (B.REGISTRY | B.DEPTH).values()}
DEPTH_TYPES = {kind for kind, _ in B.DEPTH.values()}
OUT = ("image_id", "question_order", "item", "question_type", "question", "answer")


@dataclass(frozen=True)
class Asked:
    """A question of a configuration, its parameters bound."""

    kind: str
    order: int
    params: dict = field(default_factory=dict)


def configured(questions: list[dict] | None = None) -> list[Asked]:
    """The questions of a configuration ([{name, params}], None for all scene questions) that can be asked.

    Unknown names are skipped with a warning, questions with parameters they don't take with an error in the log.
    """
    out = []
    for order, q in enumerate([{"name": k} for k in SCENE_BY_TYPE] if questions is None else questions):
        name, params = q.get("name"), dict(q.get("params") or {})
        build = SCENE_BY_TYPE.get(name) or BOX_BY_TYPE.get(name)
        if build is None:
            LOG.warning("unknown question %r is skipped", name)
            continue
        frames = 0 if name in SCENE_BY_TYPE else 2 if name in DEPTH_TYPES else 1
        try:
            inspect.signature(build).bind(*[None] * frames, **params)
            if frames == 0:
                build(**params)
        except (TypeError, ValueError) as e:
            LOG.error("question %r with %r is skipped: %s", name, params, e)
            continue
        out.append(Asked(name, order, params))
    return out


def scene_rows(s: DataFrame, asked: list[Asked]) -> DataFrame:
    """``OUT`` of scene questions over ``scenes``, one pass for all of them; items are in the order of their targets."""
    def numbered(items: Column, order: int) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(order).alias("o"), x["target"].cast("bigint").alias("item"), x["answer"].cast("string").alias("answer")))

    asks = [(a.order, SCENE_BY_TYPE[a.kind](**a.params)) for a in asked]
    arrays = [F.when(ask.where, F.filter(numbered(ask.items, order), lambda x: x["answer"].isNotNull())) for order, ask in asks]
    none = F.array().cast("array<struct<o:int,item:bigint,answer:string>>")
    rows = s.select("image_id", F.explode(F.flatten(F.array(*[F.coalesce(a, none) for a in arrays]))).alias("e")).select("image_id", "e.*")
    kind, text = (F.coalesce(*[F.when(F.col("o") == a.order, x(a)) for a in asked]) for x in (lambda a: F.lit(a.kind), lambda a: wordings.scene_sentence(a.kind, F.col("item"))))
    return rows.select("image_id", F.col("o").alias("question_order"), "item", kind.alias("question_type"), text.alias("question"), "answer")


def box_rows(det: DataFrame, asked: list[Asked], depths: DataFrame | None = None) -> DataFrame | None:
    """``OUT`` of box questions over ``boxes``; items are in the order of what they name. Depth questions need ``depths``."""
    parts = []
    for a in asked:
        if a.kind in DEPTH_TYPES and depths is None:
            LOG.warning("question %r is skipped without depths", a.kind)
            continue
        rows = BOX_BY_TYPE[a.kind](*([det, depths] if a.kind in DEPTH_TYPES else [det]), **a.params)
        grid = {k: a.params[k] for k in ("rows", "cols") if a.kind == "Quadrants" and k in a.params}
        sentence = wordings.box_sentence(a.kind, F.col("subject"), **grid)
        parts.append(rows.select("image_id", F.lit(a.order).alias("question_order"), F.lit(0).cast("bigint").alias("item"), F.lit(a.kind).alias("question_type"), sentence.alias("question"), "answer"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def qa_rows(detections: DataFrame, images: DataFrame, questions: list[dict] | None = None, *, depths: DataFrame | None = None, confidence: float = 0.2, labels: list[str] | None = None) -> DataFrame:
    """(id, image_id, source_id, question_type, question, answer): all rows of a configuration.

    ``images`` (image_id, source_id, dot_x, dot_y). Images without a box have no rows. ids are dense
    from 0 in the order of image, question and item.
    """
    asked = configured(questions)
    det = boxes(detections, confidence, labels)
    parts = []
    scene, box = [a for a in asked if a.kind in SCENE_BY_TYPE], [a for a in asked if a.kind in BOX_BY_TYPE]
    if scene:
        parts.append(scene_rows(spread(scenes(det, images), "image_id"), scene))
    if box and (rows := box_rows(det, box, depths)) is not None:
        parts.append(rows)
    if not parts:
        raise ValueError("no question of the configuration can be asked")
    rows = cut(reduce(DataFrame.unionByName, parts))  # a range sort reads its rows twice
    numbered = dense_position(rows, ["image_id", "question_order", "item", "question", "answer"], "id")
    return numbered.join(images.select("image_id", "source_id"), "image_id", "left").select("id", "image_id", "source_id", "question_type", "question", "answer")


def question_counts(qa: DataFrame) -> DataFrame:
    """(question_type, qa_pairs): the log's count of each type."""
    return qa.groupBy("question_type").agg(F.count(F.lit(1)).alias("qa_pairs"))


# Predicates of images, to be combined.

Predicate = Callable[[DataFrame], DataFrame]


def at_least_one_single(det: DataFrame) -> DataFrame:
    """(image_id) with one box, or a class of one box."""
    n = det.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id").agg(((F.min("n") == 1) | (F.sum("n") == 1)).alias("ok")).where("ok").select("image_id")


def at_least_classes(x: int) -> Predicate:
    return lambda det: det.groupBy("image_id").agg(F.size(F.collect_set("label")).alias("n")).where(F.col("n") >= x).select("image_id")


def at_least_boxes(x: int) -> Predicate:
    return lambda det: det.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= x).select("image_id")


def has_clusters(threshold: float = 50.0) -> Predicate:
    """Images with two boxes whose centres are nearer than ``threshold``.

    A range join: points meet in cells of that size, each with its own cell and half of the neighbours.
    """

    def images(det: DataFrame) -> DataFrame:
        gx, gy = F.floor(F.col("cx") / threshold), F.floor(F.col("cy") / threshold)
        one = det.select("image_id", "det_idx", "cx", "cy", gx.alias("gx"), gy.alias("gy"))
        steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        two = one.withColumn("s", F.explode(steps)).select("image_id", F.col("det_idx").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), (F.col("gx") + F.col("s.a")).alias("gx"), (F.col("gy") + F.col("s.b")).alias("gy"))
        near = one.join(two, ["image_id", "gx", "gy"]).where(F.col("det_idx") < F.col("other"))
        return near.where(F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")) < threshold).select("image_id").distinct()

    return images


def apart(det: DataFrame) -> DataFrame:
    """(image_id) with two boxes of different classes that don't overlap."""
    return B.apart_images(det)


def applicable(det: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """The boxes of images that meet all predicates; without any, all of them."""
    out = det
    for p in predicates:
        out = out.join(p(det), "image_id", "left_semi")
    return out


def question_context(det: DataFrame) -> DataFrame:
    """(image_id, centers, areas, aspects, by_class): what questions share about an image; sides count as at least 1."""
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    box = F.struct("det_idx", "label", F.array("cx", "cy").alias("center"), (w * h).alias("area"), (w / h).alias("aspect"))
    rows = det.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    at = lambda name: F.transform("b", lambda x: x[name]).alias(f"{name}s")
    classes = F.array_distinct(F.transform("b", lambda x: x["label"]))
    members = F.transform(classes, lambda c: F.struct(c.alias("key"), F.transform(F.filter("b", lambda x: x["label"] == c), lambda x: x["det_idx"]).alias("value")))
    return rows.select("image_id", at("center"), at("area"), at("aspect"), F.map_from_entries(members).alias("by_class"))


def first_images(det: DataFrame, num_samples: int, batch_size: int = 1) -> DataFrame:
    """The boxes of the first images by image_id; limits are checked once a batch, so whole batches are kept."""
    n = -(-num_samples // batch_size) * batch_size
    return det.join(det.select("image_id").distinct().orderBy("image_id").limit(n), "image_id", "left_semi")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order."""
    return rows.orderBy(*order).limit(n)


def with_prompt(qa: DataFrame, kind: str, prompt: str) -> DataFrame:
    """The rows of one question type, asked in other words."""
    return qa.where(F.col("question_type") == kind).withColumn("question", F.lit(prompt))


def large_boxes(det: DataFrame, least: float = 500.0) -> DataFrame:
    return det.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > least)


# The 80 object categories in the order of their ids from 0.
CATEGORIES = """person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter, bench, bird, cat, dog, horse, sheep, cow,
elephant, bear, zebra, giraffe, backpack, umbrella, handbag, tie, suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard, tennis racket, bottle,
wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot, hot dog, pizza, donut, cake, chair, couch, potted plant, bed,
dining table, toilet, tv, laptop, mouse, remote, keyboard, cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase, scissors, teddy bear, hair drier, toothbrush"""
CATEGORY_NAMES = [c.strip() for c in CATEGORIES.replace("\n", " ").split(",")]


def category_id(label: Column) -> Column:
    """The id of a category name, null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORY_NAMES) for x in (c, i)]), label)


def category_name(number: Column) -> Column:
    """The name of a category id; 'undefined' for others."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in CATEGORY_NAMES]), F.when(number.between(0, len(CATEGORY_NAMES) - 1), number + 1)), F.lit("undefined"))


def unknown_labels(det: DataFrame) -> DataFrame:
    """(label, n): labels that are no category."""
    return det.where(category_id(F.col("label")).isNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def validate_labels(labels: list[str]) -> tuple[bool, str | None]:
    """Whether all labels are categories, and what is wrong; no labels are fine."""
    wrong = [x for x in labels if x not in CATEGORY_NAMES]
    return (not wrong, f"unknown labels {wrong}; known: {', '.join(sorted(CATEGORY_NAMES))}" if wrong else None)
