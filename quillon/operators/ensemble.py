"""Boxes of several models fused, and boxes matched one to one.

Both are sequential by box within an image and label. As most such groups have a few boxes, the rows are
sorted by group and read as one stream per task: a call into Python per batch, not per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

GROUP = ["image_id", "label"]
CORNERS = ["x1", "y1", "x2", "y2"]
#: Boxes of a group beyond which overlaps are worked out in arrays, and rows in a batch that is handed back.
FEW, BATCH = 32, 10_000
#: Pairs of boxes of a group beyond which it is matched box by box, and pairs of groups up to this that are held at once.
MANY, AT_ONCE = 4_096, 250_000

FUSED = "image_id bigint, label string, score double, x1 double, y1 double, x2 double, y2 double, members int"


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    total = area(a)[:, None] + area(b)[None, :] - w * h
    return np.divide(w * h, total, out=np.zeros_like(w), where=total > 0)


def iou_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou_matrix`` of each box of ``a`` with that of ``b`` in the same row."""
    with np.errstate(invalid="ignore", over="ignore"):
        w = np.clip(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0, None)
        h = np.clip(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0, None)
        area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        total = area(a) + area(b) - w * h
        return np.divide(w * h, total, out=np.zeros_like(w), where=total > 0)


def by_group(rows: DataFrame, order: list[Column], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each image and label, which come first in ``rows``, sorted by ``order``.

    ``work`` gets all rows of a group as tuples and gives tuples of ``schema``.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def lists(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*[c.to_pylist() if c.null_count or not pa.types.is_primitive(c.type) else c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(chain.from_iterable(map(lists, batches)), key=itemgetter(0, 1)):
            out += work(list(group))
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, *order).mapInArrow(run, schema)


def iou_of(a: tuple, b: tuple) -> float:
    """``iou_matrix`` of two boxes."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = w * h if w > 0 and h > 0 else 0.0
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / total if total > 0 else 0.0


def first_come(takers: Sequence[Sequence[float]], givers: Sequence[Sequence[float]], iou: float) -> Iterator[tuple[int, float] | None]:
    """Of each taker, in order, the best free giver with at least ``iou``, the first of equally good ones, and their overlap."""
    theirs = np.array(givers, float) if len(givers) > FEW else None
    free = list(range(len(givers)))
    for box in takers:
        best, at = -1.0, -1
        if theirs is not None and len(free) > FEW:
            over = iou_matrix(np.array([box], float), theirs[free])[0]
            at = int(over.argmax())
            best = float(over[at])
        else:
            for j, f in enumerate(free):
                if (now := iou_of(box, givers[f])) > best:
                    best, at = now, j
        yield (free.pop(at), best) if at >= 0 and best >= iou else None


def takers_served(group: np.ndarray, takes: np.ndarray, gives: np.ndarray, score: np.ndarray, place: np.ndarray, corners: np.ndarray, iou: float) -> np.ndarray:
    """Which of the boxes get another by the rule of ``taken``, by score and place, for all groups at once; a box may both take and give.

    Pairs of too little overlap can't be taken, and a pair of which neither box has another is. The few that are left are gone
    through in order. Groups of many pairs go box by box, the others in pieces, so that no more pairs than ``AT_ONCE`` and a group's are held.
    """
    served = np.zeros(len(group), bool)
    order = np.argsort(group, kind="stable")
    t, g = order[takes[order]], order[gives[order]]
    of_t, of_g = group[t], group[g]
    first, behind = np.searchsorted(of_g, of_t), np.searchsorted(of_g, of_t, "right")
    pairs = (behind - first) * (np.searchsorted(of_t, of_t, "right") - np.searchsorted(of_t, of_t))
    unsure = np.isnan(score)
    in_place = lambda rows: (*corners[rows].T[::-1], place[rows])
    in_order = lambda rows: rows[np.lexsort((*in_place(rows), -score[rows], unsure[rows]))]

    for k in np.unique(of_t[pairs > MANY]):
        own, theirs = (rows[slice(*np.searchsorted(of, [k, k + 1]))] for rows, of in ((t, of_t), (g, of_g)))
        own, theirs = in_order(own), theirs[np.lexsort(in_place(theirs))]
        served[own] = [x is not None for x in first_come(corners[own], corners[theirs], iou)]

    few = (pairs > 0) & (pairs <= MANY)
    t, of_t, first, n = t[few], of_t[few], first[few], (behind - first)[few]
    before = (np.cumsum(n) - n)[np.searchsorted(of_t, of_t)]  # pairs before the group
    for piece in np.split(np.arange(len(t)), np.flatnonzero(np.diff(before // AT_ONCE)) + 1):
        m = n[piece]
        a = np.repeat(t[piece], m)
        b = g[np.arange(len(a)) + np.repeat(first[piece] - np.cumsum(m) + m, m)]
        over = iou_pairs(corners[a], corners[b])
        enough = over >= iou
        a, b, over = a[enough], b[enough], over[enough]
        alone = (np.bincount(a, minlength=len(group))[a] == 1) & (np.bincount(b, minlength=len(group))[b] == 1)
        served[a[alone]] = True
        a, b, over = a[~alone], b[~alone], over[~alone]
        at = np.zeros((2, len(group)), int)
        own, theirs = in_order(np.unique(a)), np.unique(b)
        at[0, own] = np.arange(len(own))
        at[1, theirs[np.lexsort(in_place(theirs))]] = np.arange(len(theirs))
        gone: set[int] = set()
        in_turn = np.lexsort((at[1, b], -over, at[0, a]))
        for x, y in zip(a[in_turn].tolist(), b[in_turn].tolist()):
            if not served[x] and y not in gone:
                served[x] = True
                gone.add(y)
    return served


def taken(takers: DataFrame, givers: DataFrame, iou: float, rank: Column | None = None) -> DataFrame:
    """(image_id, label, det_idx, score, taken_idx, iou): boxes of ``takers``, each taking the best free box of ``givers`` of its image and label with at least ``iou``.

    Both have (image_id, label, det_idx, x1..y2), ``takers`` also score. They take in the order of ``rank``, greatest first and nulls last, then of
    det_idx; of equally good boxes the one with the least det_idx is taken. iou is null for those that get none.
    """
    end = [*CORNERS, "score"]
    rank = F.lit(None).cast("double") if rank is None else F.nanvl(rank, F.lit(None).cast("double"))
    left = takers.select(*GROUP, F.lit(True).alias("takes"), rank.alias("rank"), "det_idx", *CORNERS, "score")
    right = givers.select(*GROUP, F.lit(False).alias("takes"), F.lit(None).cast("double").alias("rank"), "det_idx", *CORNERS, F.lit(None).cast("double").alias("score"))
    nan = float("nan")

    def match(group: list[tuple]) -> list[tuple]:
        k = next((i for i, r in enumerate(group) if r[2]), len(group))  # givers come first
        boxes = [tuple(nan if x is None else x for x in r[5:9]) for r in group]
        got = first_come(boxes[k:], boxes[:k], iou)
        return [(r[0], r[1], r[4], r[9], *((group[g[0]][4], g[1]) if g else (None, None))) for r, g in zip(group[k:], got)]

    rows = left.unionByName(right)
    order = [F.col("takes"), F.desc_nulls_last("rank"), F.col("det_idx"), *map(F.col, end)]
    return by_group(rows, order, match, "image_id bigint, label string, det_idx int, score double, taken_idx int, iou double")


def normalized(detections: DataFrame) -> DataFrame:
    """Corners over the image size, in 0..1 and in order."""
    c = F.col
    unit = lambda x, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c(x) / c(size)))
    return detections.withColumns({"x1": unit("x1", "img_w"), "x2": unit("x2", "img_w"), "y1": unit("y1", "img_h"), "y2": unit("y2", "img_h")}).withColumns({
        "x1": F.least("x1", "x2"), "x2": F.greatest("x1", "x2"), "y1": F.least("y1", "y2"), "y2": F.greatest("y1", "y2")})


def gathered(models: dict[str, DataFrame]) -> DataFrame:
    """The detections of several models (image_id, label, score, x1..y2) with ``model``; a model without boxes adds none, and weights go by name."""
    cols = ["image_id", "label", "score", "x1", "y1", "x2", "y2"]
    parts = [df.select(*cols, F.lit(name).alias("model")) for name, df in models.items()]
    return reduce(DataFrame.unionByName, parts)


def weighted_fusion(detections: DataFrame, weights: dict[str, float], iou: float = 0.55, skip: float = 0.0) -> DataFrame:
    """Weighted box fusion, as published, of detections (image_id, model, label, score, x1..y2) by image and label.

    Boxes are taken by weighted score, each joins the fused box it overlaps most if by more than
    ``iou``; a fused box is the mean of its members by score, its score is scaled by how many of
    the models' weights took part. Unknown models weigh 1.
    """
    total, models = sum(weights.values()) or 1.0, len(weights)

    def fuse(group: list[tuple]) -> list[tuple]:
        boxes: list[tuple] = []
        sums: list[list[float]] = []  # of the members: weights, weighted corners, plain corners, number
        known = np.empty((len(group), 4)) if len(group) > FEW else None
        for r in group:
            box, w = tuple(r[3:7]), r[2]
            best, at = iou, -1
            if known is not None and len(boxes) > FEW:
                over = iou_matrix(np.array([box]), known[: len(boxes)])[0]
                if over.max() > best:
                    at = int(over.argmax())
            else:
                for j, b in enumerate(boxes):
                    if (now := iou_of(box, b)) > best:
                        best, at = now, j
            if at < 0:
                at = len(boxes)
                boxes.append(box)
                sums.append([w, *(w * x for x in box), *box, 1])
            else:
                sums[at] = s = [x + y for x, y in zip(sums[at], [w, *(w * x for x in box), *box, 1])]
                boxes[at] = tuple(x / s[0] for x in s[1:5]) if s[0] > 0 else tuple(x / s[9] for x in s[5:9])
            if known is not None:
                known[at] = boxes[at]
        return [(r[0], r[1], s[0] / s[9] * min(s[9], models) / total, *b, s[9]) for b, s in zip(boxes, sums)]

    weight = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(w))) for m, w in weights.items()], F.lit(1.0))
    rows = detections.where("label is not null").where(~F.isnan("score") & (F.col("score") >= skip))
    rows = rows.select(*GROUP, (F.col("score") * weight).alias("w"), *CORNERS, "model")
    return by_group(rows, [F.desc("w"), *map(F.col, CORNERS), F.col("model")], fuse, FUSED)


def greedy_match(placed: DataFrame, found: DataFrame, iou: float = 0.30) -> DataFrame:
    """(image_id, label, placed_idx, found_idx, iou): each placed box, in order, takes the best unused found box of its label.

    Both have (image_id, label, det_idx, x1..y2); boxes without a partner have a null found_idx.
    """
    got = taken(placed.withColumn("score", F.lit(None).cast("double")), found, iou)
    return got.select(*GROUP, F.col("det_idx").alias("placed_idx"), F.col("taken_idx").alias("found_idx"), F.coalesce("iou", F.lit(0.0)).alias("iou"))
