"""Questions about the boxes of any image: counts, sizes, places and depths by class.

Each builder takes ``boxes`` (partitioned by image_id, so that its groups and windows need no
further shuffle) and gives (image_id, subject, answer): ``subject`` is what the question names.
Ties go to the box or class that comes first in det_idx. Answers too close to call have no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import geo
from quillon.operators.scenes import class_counts

C = F.col
OUT = ("image_id", "subject", "answer")


def _out(df: DataFrame, subject: Column, answer: Column) -> DataFrame:
    return df.select("image_id", subject.cast("string").alias("subject"), answer.cast("string").alias("answer")).where("answer is not null")


def _by_image(*order: Column) -> Window:
    return Window.partitionBy("image_id").orderBy(*order)


def with_counts(det: DataFrame) -> DataFrame:
    """``det`` with n_class (boxes of its class), n_classes, n_boxes and has_single of its image."""
    image, label = Window.partitionBy("image_id"), Window.partitionBy("image_id", "label")
    rows = det.withColumn("n_class", F.count(F.lit(1)).over(label)).withColumn("n_boxes", F.count(F.lit(1)).over(image))
    return rows.withColumn("has_single", (F.min("n_class").over(image) == 1) | (C("n_boxes") == 1)).withColumn("n_classes", F.size(F.collect_set("label").over(image)))


def class_pairs(det: DataFrame) -> DataFrame:
    """(image_id, l1, n1, s1, l2, n2, s2) of every ordered pair of classes in an image."""
    k = class_counts(det)
    one = k.select("image_id", C("label").alias("l1"), C("n").alias("n1"), C("first_seen").alias("s1"))
    two = k.select("image_id", C("label").alias("l2"), C("n").alias("n2"), C("first_seen").alias("s2"))
    return one.join(two, "image_id").where("l1 <> l2")


def apart_images(det: DataFrame) -> DataFrame:
    """(image_id) of images with two boxes of different classes that don't overlap."""
    b = [c for c in ("det_idx", "label", "x1", "y1", "x2", "y2")]
    one = det.select("image_id", F.struct(*b).alias("a"))
    two = det.select("image_id", F.struct(*b).alias("b"))
    pairs = one.join(two, "image_id").where((C("a.det_idx") < C("b.det_idx")) & (C("a.label") != C("b.label")))
    return pairs.where(geo.intersection(C("a"), C("b")) == 0).select("image_id").distinct()


def how_many(det: DataFrame) -> DataFrame:
    return _out(class_counts(det), C("label"), C("n"))


def thirds(det: DataFrame, buffer_ratio: float = 0.05) -> DataFrame:
    if not 0 <= buffer_ratio <= 0.5:
        raise ValueError("buffer_ratio must be between 0 and 0.5")
    w, b = C("img_w"), buffer_ratio * C("img_w")
    lo, hi = w / 3, 2 * w / 3
    rows = with_counts(det).where("has_single and n_class = 1")
    near = reduce(lambda p, q: p | q, [F.abs(C(x) - line) < b for x in ("x1", "x2") for line in (lo, hi)])
    answer = F.when(C("x2") < lo - b, "A").when((C("x1") > lo + b) & (C("x2") < hi - b), "B").when(C("x1") > hi + b, "C")
    return _out(rows.where(~near), C("label"), answer)


def _shape(threshold: float) -> Column:
    ratio = (C("x2") - C("x1")) / F.greatest(C("y2") - C("y1"), F.lit(1e-6))
    return F.when(F.abs(ratio - 1) >= threshold, F.when(ratio > 1, "Yes").otherwise("No"))


def width_vs_height(det: DataFrame, threshold: float = 0.75, reverse: bool = False, only: list[str] | None = None) -> DataFrame:
    """``reverse`` asks whether it is higher than wide."""
    rows = with_counts(det).where("has_single and n_class = 1")
    rows = rows.where(C("label").isin(*only)) if only is not None else rows
    answer = _shape(threshold)
    return _out(rows, C("label"), F.when(answer == "Yes", "No").when(answer == "No", "Yes") if reverse else answer)


def quadrants(det: DataFrame, rows: int = 3, cols: int = 3, margin_ratio: float = 0.1) -> DataFrame:
    if rows * cols > 12 or not 0 <= margin_ratio <= 0.5:
        raise ValueError("at most 12 cells, margin_ratio between 0 and 0.5")
    qw, qh = C("img_w") / cols, C("img_h") / rows
    r, c = F.floor(C("y1") / qh), F.floor(C("x1") / qw)
    inside = (r == F.floor(C("y2") / qh)) & (c == F.floor(C("x2") / qw)) & (C("x1") >= c * qw + margin_ratio * qw) & (C("x2") <= (c + 1) * qw - margin_ratio * qw) & (C("y1") >= r * qh + margin_ratio * qh) & (C("y2") <= (r + 1) * qh - margin_ratio * qh)
    return _out(with_counts(det).where("has_single and n_class = 1").where(inside), C("label"), r * cols + c + 1)


def largest(det: DataFrame, threshold: float = 0.3) -> DataFrame:
    rows = with_counts(det).where("n_classes >= 2").withColumn("area", (C("x2") - C("x1")) * (C("y2") - C("y1")))
    w = _by_image(F.desc("area"), C("det_idx"))
    top = rows.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("area").over(w)).where("k = 1")
    return _out(top.where(C("area") > (1 + threshold) * C("next")), F.lit(""), C("label"))


def _top_classes(values: DataFrame, k: int, keep: Callable[[Column, Column], Column], order: Column) -> DataFrame:
    """The first k classes of ``values`` (image_id, label, v, first_seen), if each keeps apart from the next."""
    w = _by_image(order, C("first_seen"))
    ranked = values.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("v").over(w)).where(C("k") <= k)
    ok = F.when(C("k") < k, keep(C("v"), C("next"))).otherwise(F.lit(True))
    per = ranked.withColumn("ok", ok).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.struct("k", "label"))).alias("top"))
    return _out(per.where((C("n") == k) & C("ok")), F.lit(str(k)), F.array_join(F.transform("top", lambda x: x["label"]), ", "))


def rank_largest(det: DataFrame, k: int = 3, margin_ratio: float = 0.3) -> DataFrame:
    v = det.groupBy("image_id", "label").agg(F.max((C("x2") - C("x1")) * (C("y2") - C("y1"))).alias("v"), F.min("det_idx").alias("first_seen"))
    return _top_classes(v, k, lambda a, b: a >= (1 + margin_ratio) * b, F.desc("v"))


def _extreme(det: DataFrame, margin_ratio: float, most: bool) -> DataFrame:
    w = _by_image(F.desc("n") if most else F.asc("n"), C("first_seen"))
    rows = class_counts(det).withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).where("k = 1 and next is not null")
    clear = C("n") >= (1 + margin_ratio) * C("next") if most else C("next") >= (1 + margin_ratio) * C("n")
    return _out(rows.where(clear), F.lit(""), C("label"))


def most(det: DataFrame, margin_ratio: float = 0.2) -> DataFrame:
    return _extreme(det, margin_ratio, True)


def least(det: DataFrame, margin_ratio: float = 0.2) -> DataFrame:
    return _extreme(det, margin_ratio, False)


def _beside(det: DataFrame, left: bool) -> DataFrame:
    """A box wholly to one side of another doesn't overlap it, so the outermost edges decide."""
    k = det.groupBy("image_id", "label").agg(F.min("x1").alias("lo"), F.min("x2").alias("lo2"), F.max("x1").alias("hi1"), F.max("x2").alias("hi"))
    one = k.select("image_id", C("label").alias("l1"), C("lo2").alias("a_lo2"), C("hi1").alias("a_hi1"))
    two = k.select("image_id", C("label").alias("l2"), C("lo2").alias("b_lo2"), C("hi1").alias("b_hi1"))
    pairs = one.join(two, "image_id").where("l1 <> l2").join(apart_images(det), "image_id", "left_semi")
    yes = C("a_lo2") < C("b_hi1") if left else C("a_hi1") > C("b_lo2")
    return _out(pairs, F.concat_ws("/", "l1", "l2"), F.when(yes, "Yes").otherwise("No"))


def left_of(det: DataFrame) -> DataFrame:
    return _beside(det, True)


def right_of(det: DataFrame) -> DataFrame:
    return _beside(det, False)


def _outermost(rows: DataFrame, margin_ratio: float, left: bool) -> DataFrame:
    w = _by_image(C("x1") if left else F.desc("x2"), C("det_idx"))
    mid, room = C("img_w") / 2, margin_ratio * C("img_w")
    ranked = rows.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("x1" if left else "x2").over(w))
    half = ((C("x1") < mid) & (C("x2") < mid)) if left else ((C("x1") > mid) & (C("x2") > mid))
    apart = C("next").isNull() | ((C("next") - C("x2") >= room) if left else (C("x1") - C("next") >= room))
    return ranked.withColumn("half", half).withColumn("apart", apart)


def leftmost(det: DataFrame, margin_ratio: float = 0.05) -> DataFrame:
    rows = _outermost(with_counts(det).where("has_single"), margin_ratio, True)
    return _out(rows.where("k = 1 and half and apart"), F.lit(""), C("label"))


def rightmost(det: DataFrame, margin_ratio: float = 0.05) -> DataFrame:
    rows = _outermost(with_counts(det).where("has_single"), margin_ratio, False)
    return _out(rows.where("k = 1 and half and apart"), F.lit(""), C("label"))


def _outermost_shape(det: DataFrame, left: bool, threshold: float, margin_ratio: float) -> DataFrame:
    """Of the classes with one box, the first that stands free; there its shape is asked about, or nothing."""
    rows = _outermost(with_counts(det).where("has_single and n_class = 1"), margin_ratio, left).where("half and apart")
    first = rows.withColumn("f", F.row_number().over(_by_image(C("k")))).where("f = 1")
    return _out(first, F.lit(""), _shape(threshold))


def leftmost_wh(det: DataFrame, threshold: float = 0.75, margin_ratio: float = 0.05) -> DataFrame:
    return _outermost_shape(det, True, threshold, margin_ratio)


def rightmost_wh(det: DataFrame, threshold: float = 0.75, margin_ratio: float = 0.05) -> DataFrame:
    return _outermost_shape(det, False, threshold, margin_ratio)


def are_more(det: DataFrame, margin_ratio: float = 0.2) -> DataFrame:
    answer = F.when((C("n1") > C("n2")) & (C("n1") >= (1 + margin_ratio) * C("n2")), "Yes").when((C("n2") > C("n1")) & (C("n2") >= (1 + margin_ratio) * C("n1")), "No")
    return _out(class_pairs(det).where("s1 < s2"), F.concat_ws("/", "l1", "l2"), answer)


def which_more(det: DataFrame, margin_ratio: float = 0.2) -> DataFrame:
    three = class_counts(det).select("image_id", C("label").alias("l3"), C("n").alias("n3"), C("first_seen").alias("s3"))
    rows = class_pairs(det).where("s1 < s2").join(three, "image_id").where("s2 < s3")
    ranked = F.sort_array(F.array("n1", "n2", "n3"), asc=False)
    clear = (ranked[0] > ranked[1]) & (ranked[0] >= (1 + margin_ratio) * ranked[1])
    answer = F.when(C("n1") == ranked[0], C("l1")).when(C("n2") == ranked[0], C("l2")).otherwise(C("l3"))
    return _out(rows.where(clear), F.concat_ws("/", "l1", "l2", "l3"), F.concat(answer, F.lit("s")))


def more_than(det: DataFrame, threshold: float = 2.0) -> DataFrame:
    n = C("n")
    yes = F.greatest(F.lit(1), F.floor(n / threshold))
    yes = F.when(yes == n, F.greatest(F.lit(1), yes - 1)).otherwise(yes)
    no = F.ceil(n * threshold)
    no = F.when(no == n, no + 1).otherwise(no)
    pair = F.explode(F.array(F.struct(yes.alias("t"), F.lit("Yes").alias("a")), F.struct(no.alias("t"), F.lit("No").alias("a"))))
    rows = class_counts(det).withColumn("e", pair)
    return _out(rows, F.concat_ws("/", "label", C("e.t").cast("string")), C("e.a"))


def less_than(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Target 0 asks whether there are any."""
    n = C("n")
    yes = F.ceil(n / threshold)
    yes = F.when(yes == n, yes + 1).otherwise(yes)
    no = F.greatest(F.lit(1), F.floor(n * threshold))
    no = F.when(no == n, F.greatest(F.lit(1), no - 1)).otherwise(no)
    any_ = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit("Yes").alias("a"))
    pair = F.explode(F.array(F.struct(yes.alias("t"), F.lit("Yes").alias("a")), F.when(no == 1, any_).otherwise(F.struct(no.alias("t"), F.lit("No").alias("a")))))
    rows = class_counts(det).withColumn("e", pair)
    return _out(rows, F.concat_ws("/", "label", C("e.t").cast("string")), C("e.a"))


def multi_choice(det: DataFrame, seed: int = 0) -> DataFrame:
    """Ranges A/B/C in the subject; which letter the right range has is drawn by a hash of image and class."""
    k = det.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.var_pop("score").alias("v")).where("n >= 4")
    low_c, high_c = F.when(C("v") > 0.05, 0.4).otherwise(0.5), F.when(C("v") > 0.05, 1.8).otherwise(1.5)
    k = k.withColumn("low", F.greatest(F.lit(0), F.floor(low_c * C("n") - 1e-6))).withColumn("mid", F.floor(high_c * C("n")))
    k = k.withColumn("top", C("mid") + 1 + F.greatest(F.lit(2), C("mid") - C("low") - 1))
    text = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    ranges = F.array(text(F.lit(0), C("low")), text(C("low") + 1, C("mid")), text(C("mid") + 1, C("top")))
    turn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), C("image_id").cast("string"), "label")), 1, 4), 16, 10).cast("int"), F.lit(3))
    shown = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.element_at(ranges, F.pmod(i + turn, F.lit(3)) + 1))
    letter = F.element_at(F.array(F.lit("B"), F.lit("A"), F.lit("C")), turn + 1)
    return _out(k, F.concat_ws("/", "label", F.array_join(shown, "/")), letter)


def _depth_pairs(det: DataFrame, depths: DataFrame, margin_ratio: float) -> DataFrame:
    b = ("det_idx", "label", "x1", "y1", "x2", "y2", "depth")
    rows = det.join(depths.select("image_id", "det_idx", C("mean_depth").alias("depth")), ["image_id", "det_idx"], "left")
    one, two = rows.select("image_id", F.struct(*b).alias("a")), rows.select("image_id", F.struct(*b).alias("b"))
    pairs = one.join(two, "image_id").where("a.label <> b.label").join(apart_images(det), "image_id", "left_semi")
    a, c = C("a.depth"), C("b.depth")
    sure = (geo.iou(C("a"), C("b")) == 0) & (F.abs(a - c) >= margin_ratio * F.least(a, c))
    return pairs.withColumn("nearer", F.coalesce(sure & (a < c), F.lit(False))).withColumn("farther", F.coalesce(sure & (a > c), F.lit(False)))


def closer(det: DataFrame, depths: DataFrame, margin_ratio: float = 0.1) -> DataFrame:
    rows = _depth_pairs(det, depths, margin_ratio).groupBy("image_id", C("a.label").alias("l1"), C("b.label").alias("l2")).agg(F.bool_or("nearer").alias("yes"))
    return _out(rows, F.concat_ws("/", "l1", "l2"), F.when(C("yes"), "Yes").otherwise("No"))


def farther(det: DataFrame, depths: DataFrame, margin_ratio: float = 0.1) -> DataFrame:
    rows = _depth_pairs(det, depths, margin_ratio).groupBy("image_id", C("a.label").alias("l1"), C("b.label").alias("l2")).agg(F.bool_or("farther").alias("yes"))
    return _out(rows, F.concat_ws("/", "l1", "l2"), F.when(C("yes"), "Yes").otherwise("No"))


def depth_ranking(det: DataFrame, depths: DataFrame, k: int = 3, margin_ratio: float = 0.2) -> DataFrame:
    rows = det.join(depths.where("mean_depth is not null"), ["image_id", "det_idx"])
    v = rows.groupBy("image_id", "label").agg(F.min("mean_depth").alias("v"), F.min("det_idx").alias("first_seen"))
    return _top_classes(v, k, lambda a, b: a <= (1 - margin_ratio) * b, F.asc("v"))


def _windows(cx: np.ndarray, cy: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(residual variance of a line through it, start, end) of every run of 3 or more points, short ones first."""
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (cx, cy, cx * cx, cx * cy, cy * cy)]
    for size in range(3, len(cx) + 1):
        for start in range(len(cx) - size + 1):
            sx, sy, sxx, sxy, syy = (s[start + size] - s[start] for s in sums)
            vx, vxy, vy = sxx / size - (sx / size) ** 2, sxy / size - sx * sy / size**2, syy / size - (sy / size) ** 2
            yield max(0.0, vy - (vxy * vxy / vx if vx > 1e-9 else 0.0)), start, start + size


def _options(correct: str, labels: list[str], key: str) -> tuple[str, str] | None:
    """Three options in an order drawn by ``key``, and the letter of the right one; None without two other options."""
    rng = np.random.default_rng(abs(int.from_bytes(key.encode(), "big")) % (1 << 63))
    names = sorted(set(labels))
    for _ in range(11):
        order = [names[i] for i in rng.permutation(len(names))]
        one, two = ", ".join(order[:3]), ", ".join(order[-2:])
        if len({correct, one, two}) == 3:
            options = [(correct, one, two)[i] for i in rng.permutation(3)]
            return "/".join(options), "ABC"[options.index(correct)]
    return None


def _per_image(det: DataFrame, least_boxes: int, work: Callable[[pd.DataFrame], tuple[str, str] | None]) -> DataFrame:
    """``work`` on the boxes of each image with enough of them, in the order of det_idx."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = work(pdf.sort_values("det_idx")) if len(pdf) >= least_boxes else None
        return pd.DataFrame([(key[0], *got)] if got else [], columns=list(OUT))

    return det.groupBy("image_id").applyInPandas(run, "image_id bigint, subject string, answer string")


def objects_in_row(det: DataFrame, variance_threshold: float = 0.1) -> DataFrame:
    def work(pdf: pd.DataFrame) -> tuple[str, str]:
        p = pdf.sort_values("cx", kind="stable")
        h = float(p.img_h.iloc[0])
        return "", "Yes" if any(v / h**2 < variance_threshold for v, _, _ in _windows(p.cx.to_numpy(), p.cy.to_numpy())) else "No"

    return _per_image(det, 3, work)


def objects_in_line(det: DataFrame, variance_threshold: float = 0.1, seed: int = 0) -> DataFrame:
    def work(pdf: pd.DataFrame) -> tuple[str, str] | None:
        p = pdf.sort_values("cx", kind="stable")
        h = float(p.img_h.iloc[0])
        v, a, b = min(_windows(p.cx.to_numpy(), p.cy.to_numpy()), key=lambda x: x[0])
        return _options(", ".join(sorted(set(p.label.iloc[a:b]))), list(p.label), f"{seed}/{p.image_id.iloc[0]}") if v / h**2 < variance_threshold else None

    return _per_image(det, 3, work)


def clusters(points: np.ndarray, eps: float, least_points: int) -> np.ndarray:
    """Density-based clusters of points in the order of their first core point; -1 for noise."""
    near = np.hypot(points[:, None, 0] - points[None, :, 0], points[:, None, 1] - points[None, :, 1]) <= eps
    core = near.sum(axis=1) >= least_points
    out, at = np.full(len(points), -1), -1
    for i in range(len(points)):
        if not core[i] or out[i] >= 0:
            continue
        at += 1
        todo, out[i] = [i], at
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (out < 0)):
                out[j] = at
                if core[j]:
                    todo.append(j)
    return out


def most_clustered(det: DataFrame, eps_ratio: float = 0.05, min_samples: int = 3, seed: int = 0) -> DataFrame:
    def work(pdf: pd.DataFrame) -> tuple[str, str] | None:
        pts = pdf[["cx", "cy"]].to_numpy()
        found = clusters(pts, eps_ratio * float(np.hypot(pdf.img_w.iloc[0], pdf.img_h.iloc[0])), min_samples)
        if found.max() < 1:
            return None
        tight = min(range(found.max() + 1), key=lambda k: pts[found == k].var(axis=0).mean())
        return _options(", ".join(sorted(set(pdf.label[found == tight]))), list(pdf.label), f"{seed}/{pdf.image_id.iloc[0]}")

    return _per_image(det, 9, work)


#: Query name to (question type, builder); the builders under DEPTH take depths too.
REGISTRY: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "thirds": ("IsObjectCentered", thirds),
    "width_vs_height": ("WidthVsHeight", width_vs_height),
    "quadrants": ("Quadrants", quadrants),
    "largest": ("LargestAppearance", largest),
    "rank_largest_k": ("RankLargestK", rank_largest),
    "most": ("MostAppearance", most),
    "least": ("LeastAppearance", least),
    "left_of": ("LeftOf", left_of),
    "right_of": ("RightOf", right_of),
    "leftmost": ("LeftMost", leftmost),
    "rightmost": ("RightMost", rightmost),
    "how_many": ("HowMany", how_many),
    "are_more": ("AreMore", are_more),
    "which_more": ("WhichMore", which_more),
    "leftmost_wh": ("LeftMostWidthVsHeight", leftmost_wh),
    "rightmost_wh": ("RightMostWidthVsHeight", rightmost_wh),
    "more_than": ("MoreThanThresholdHowMany", more_than),
    "less_than": ("LessThanThresholdHowMany", less_than),
    "multi_choice": ("MultiChoiceHowMany", multi_choice),
    "objects_in_row": ("ObjectsInRow", objects_in_row),
    "objects_in_line": ("ObjectsInLine", objects_in_line),
    "most_clustered": ("MostClusteredObjects", most_clustered),
}
DEPTH: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "closer": ("Closer", closer),
    "farther": ("Farther", farther),
    "depth_ranking": ("DepthRanking", depth_ranking),
}
