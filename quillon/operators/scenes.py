"""Labelled boxes by image, and what questions about a scene share.

``boxes`` cleans the detections, ``scenes`` brings the boxes of an image together once; everything
about one image is then an expression over its arrays, without further shuffles or joins. Orders,
assignments and paths that are too close to call are null, and what depends on them has no answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import geo

#: Points join a column if they lie within so many pixels of its mean x.
COLUMN_WIDTH = 40.0
CONFIDENCE = 0.2
ANIMALS = ["zebra", "elephant", "giraffe"]
BOX = ["x1", "y1", "x2", "y2"]


def plain_label(label: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(label), r"[_\s]+", " ")), F.lit(""))


def boxes(detections: DataFrame, confidence: float = CONFIDENCE, labels: list[str] | None = None) -> DataFrame:
    """One row per (image_id, det_idx) with a known label, score >= ``confidence`` and corners in order.

    ``labels`` keeps only these; None or none of them keeps all. Rows with null keys, label, score
    or corners are no boxes; of repeated rows with other values the greatest stays. Partitioned by
    image_id, so that work by image needs no further shuffle.
    """
    c = F.col
    rows = detections.where(c("score") >= confidence).select(
        "image_id", "det_idx", "img_w", "img_h", plain_label(c("label")).alias("label"), "score",
        F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"),
        (c("x1").isNotNull() & c("x2").isNotNull() & c("y1").isNotNull() & c("y2").isNotNull()).alias("whole"),
    ).where("whole and label is not null and image_id is not null and det_idx is not null")
    if labels:
        rows = rows.where(c("label").isin(*labels))
    best = F.max(F.struct("label", "score", *BOX, "img_w", "img_h"))
    one = rows.repartition("image_id").groupBy("image_id", "det_idx").agg(best.alias("b")).select("image_id", "det_idx", "b.*")
    return one.withColumns({"cx": (c("x1") + c("x2")) / 2, "cy": (c("y1") + c("y2")) / 2})


def class_counts(det: DataFrame) -> DataFrame:
    """(image_id, label, n, first_seen)"""
    return det.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("det_idx").alias("first_seen"))


def of_label(*labels: str) -> Column:
    return F.filter("dets", lambda d: d["label"].isin(*labels))


def left_to_right(points: Column, width: Column | float = COLUMN_WIDTH) -> Column:
    """Boxes in the order of their numbers: columns from left to right, each from top to bottom.

    Points sorted by x join the current column while they lie within ``width`` of its running
    mean. That is not a rule on gaps between neighbours, so it is a fold.
    """
    kind = "struct<g:int,cy:double,cx:double,det_idx:int,x1:double,y1:double,x2:double,y2:double>"
    rows = F.array_sort(F.transform(points, lambda d: F.struct(d["cx"].alias("cx"), d["det_idx"].alias("det_idx"), d["cy"].alias("cy"), *[d[b].alias(b) for b in BOX])))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.array().cast(f"array<{kind}>").alias("out"))

    def put(a: Column, v: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(v["cx"] - F.try_divide(a["s"], a["n"])) <= width)
        g = F.when(joins, a["g"]).otherwise(a["g"] + 1)
        row = F.struct(g.alias("g"), v["cy"].alias("cy"), v["cx"].alias("cx"), v["det_idx"].alias("det_idx"), *[v[b].alias(b) for b in BOX]).cast(kind)
        return F.struct(
            g.alias("g"),
            F.when(joins, a["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(joins, a["s"] + v["cx"]).otherwise(v["cx"]).alias("s"),
            F.concat(a["out"], F.array(row)).alias("out"),
        )

    return F.array_sort(F.aggregate(rows, start, put, lambda a: a["out"]))


def assigned(objects: Column, places: Column, edge: Column) -> Column:
    """Index from 0 of the nearest place of each object, null where the second is not farther by more than ``edge``."""
    near = F.transform(objects, lambda o: F.array_sort(F.transform(places, lambda p, i: F.struct(geo.distance(p["cx"], p["cy"], o["cx"], o["cy"]).alias("d"), i.alias("i")))))
    return F.transform(near, lambda a: F.when(F.size(a) == 1, a[0]["i"]).when((F.size(a) > 1) & (F.try_element_at(a, F.lit(2))["d"] - F.try_element_at(a, F.lit(1))["d"] > edge), F.try_element_at(a, F.lit(1))["i"]))


def all_known(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull())


def distance_order(ref: Column, places: Column, edge: Column) -> Column:
    """(d, i) by distance from ``ref``; null if any two neighbours in the order are within ``edge``, or without ref or places."""
    order = F.array_sort(F.transform(places, lambda p, i: F.struct(geo.distance(p["cx"], p["cy"], ref["cx"], ref["cy"]).alias("d"), i.alias("i"))))
    apart = F.forall(F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: b["d"].isNull() | (b["d"] - a["d"] > edge)), lambda ok: ok)
    return F.when(ref.isNotNull() & (F.size(places) > 0) & apart, order)


def scenes(det: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """One row per image with its boxes as arrays and the orders and assignments that questions share.

    ``headings`` (image_id, dot_x, dot_y) adds the heading dot; one row per image.
    """
    c = F.col
    box = F.struct("det_idx", "label", "score", *BOX, "cx", "cy")
    one = det.groupBy("image_id").agg(F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"), F.array_sort(F.collect_list(box)).alias("dets"))
    if headings is not None:
        one = one.join(headings.select("image_id", "dot_x", "dot_y"), "image_id", "left")
    labels = F.transform("dets", lambda d: d["label"])
    one = one.withColumns({
        "scale": geo.scale(c("img_w"), c("img_h")),
        "clock": F.try_element_at(of_label("clock"), F.lit(1)),
        "benches": left_to_right(of_label("bench")),
        "signs": left_to_right(of_label("stop sign")),
        "people": of_label("person"),
        "animals": of_label(*ANIMALS),
        "has_single": (F.size("dets") == 1) | F.exists(F.array_distinct(labels), lambda x: F.size(F.filter(labels, lambda y: y == x)) == 1),
    })
    edge_a, edge_d = geo.margin(geo.ASSIGN_MARGIN, c("scale")), geo.margin(geo.DISTANCE_MARGIN, c("scale"))
    return one.withColumns({
        "people_at": assigned(c("people"), c("benches"), edge_a),
        "animals_at": assigned(c("animals"), c("signs"), edge_a),
        "bench_order": distance_order(c("clock"), c("benches"), edge_d),
        "sign_order": distance_order(c("clock"), c("signs"), edge_d),
    })


def at_place(assignment: Column, i: Column) -> Column:
    """How many objects are assigned to place ``i``."""
    return F.size(F.filter(assignment, lambda a: a == i))


def detour(clock: Column, target: Column, obstacles: Column, w: Column, h: Column, s: Column) -> Column:
    """keep straight, turn left or turn right on the way from the clock to the target; null if too close to call."""
    reach = F.greatest((clock["x2"] - clock["x1"]) / 2, (clock["y2"] - clock["y1"]) / 2)
    edge = geo.margin(geo.PATH_MARGIN, s)
    ends = (clock["cx"], clock["cy"], target["cx"], target["cy"])
    tests = F.transform(obstacles, lambda o: F.struct(
        geo.entry_t(*ends, o, reach).alias("t"),
        (geo.entry_t(*ends, o, F.greatest(F.lit(0.0), reach - edge)).isNotNull() != geo.entry_t(*ends, o, reach + edge).isNotNull()).alias("unsure"),
        ((o["x1"] + o["x2"]) / 2).alias("cx"),
        ((o["y1"] + o["y2"]) / 2).alias("cy"),
    ))
    hx, hy = target["cx"] - clock["cx"], target["cy"] - clock["cy"]
    side = (w / 2.0 - clock["cx"]) * -hy + (h / 2.0 - clock["cy"]) * hx

    def judge(hits: Column) -> Column:
        first, second = F.try_element_at(hits, F.lit(1)), F.try_element_at(hits, F.lit(2))
        ox, oy = first["cx"] - clock["cx"], first["cy"] - clock["cy"]
        cross = hx * oy - hy * ox
        way = F.when(cross > 0, "turn left").when(cross < 0, "turn right").when(side >= 0, "turn left").otherwise("turn right")
        close = F.coalesce(second["t"] - first["t"] <= geo.ENTRY_GAP, F.lit(False))
        head_on = F.abs(geo.angle_between(hx, hy, ox, oy)) <= geo.HEAD_ON
        return F.when(F.size(hits) == 0, "keep straight").when(~close & ~head_on, way)

    def decide(x: Column) -> Column:
        hits = F.array_sort(F.transform(F.filter(x, lambda y: y["t"].isNotNull()), lambda y: F.struct(y["t"].alias("t"), y["cx"].alias("cx"), y["cy"].alias("cy"))))
        return F.when(~F.exists(x, lambda y: y["unsure"]), bound(hits, judge))

    return bound(tests, decide)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]
