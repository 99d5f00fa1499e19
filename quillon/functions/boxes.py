"""Box forms, placement and masks as column expressions; masks are strings of 0 and 1 bytes read in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from quillon.functions import geo


def relative(b: Column, w: Column, h: Column) -> Column:
    """Corners over the image size."""
    return F.struct((b["x1"] / w).alias("x1"), (b["y1"] / h).alias("y1"), (b["x2"] / w).alias("x2"), (b["y2"] / h).alias("y2"))


def top_left(b: Column) -> Column:
    """(x, y, w, h), x and y being the upper left corner."""
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def relative_top_left(b: Column, w: Column, h: Column) -> Column:
    t = top_left(b)
    return F.struct((t["x"] / w).alias("x"), (t["y"] / h).alias("y"), (t["w"] / w).alias("w"), (t["h"] / h).alias("h"))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Corners of a box given by its centre and size."""
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def inside(b: Column, w: Column, h: Column, tolerance: float = 0.0) -> Column:
    """Whether a box lies within the image, give or take ``tolerance`` pixels."""
    t = F.lit(tolerance)
    return (b["x1"] >= -t) & (b["y1"] >= -t) & (b["x2"] <= w + t) & (b["y2"] <= h + t)


def point_gap(px: Column, py: Column, b: Column) -> Column:
    """Distance of a point from a box, 0 inside."""
    dx = F.greatest(F.lit(0.0), b["x1"] - px, px - b["x2"])
    dy = F.greatest(F.lit(0.0), b["y1"] - py, py - b["y2"])
    return F.sqrt(dx * dx + dy * dy)


def overlap(a: Column, b: Column, pad: float = 0.0) -> Column:
    """Whether boxes overlap, touching ones don't; ``pad`` pixels are kept free around them."""
    p = F.lit(pad)
    return (a["x1"] < b["x2"] + p) & (b["x1"] < a["x2"] + p) & (a["y1"] < b["y2"] + p) & (b["y1"] < a["y2"] + p)


def union_box(bs: Column) -> Column:
    """The box around an array of boxes, null for none."""
    side = lambda name, f: f(F.transform(bs, lambda b: b[name])).alias(name)
    return F.when(F.size(bs) > 0, F.struct(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max)))


def letterboxed(b: Column, w: Column, h: Column, new_w: float, new_h: float) -> Column:
    """A box of a w x h image after it was scaled to fit new_w x new_h and centred there."""
    ratio = F.least(F.lit(new_h) / h, F.lit(new_w) / w)
    left, top = (F.lit(new_w) - w * ratio) / 2, (F.lit(new_h) - h * ratio) / 2
    return F.struct((b["x1"] * ratio + left).alias("x1"), (b["y1"] * ratio + top).alias("y1"), (b["x2"] * ratio + left).alias("x2"), (b["y2"] * ratio + top).alias("y2"))


def resized(w: Column, h: Column, longest: int) -> Column:
    """(w, h) of an image whose longest side is brought down to ``longest``; smaller ones stay."""
    ratio = F.least(F.lit(1.0), F.lit(longest) / F.greatest(w, h))
    return F.struct(F.rint(w * ratio).cast("int").alias("w"), F.rint(h * ratio).cast("int").alias("h"))


# The angles of an obstacle beside the way that are clear, in degrees, and pixels by which a target must be nearer than others.
CLEAR_ANGLES, NEARER_BY = (12.0, 40.0), 80.0


def angle_is_clear(hx: Column, hy: Column, ox: Column, oy: Column) -> Column:
    """Whether an obstacle lies clearly to one side of the heading, yet before it."""
    return F.abs(F.degrees(geo.angle_between(hx, hy, ox, oy))).between(*CLEAR_ANGLES)


def clearly_nearest(distance: Column, others: Column) -> Column:
    """Whether every other distance is greater by more than NEARER_BY."""
    return F.forall(others, lambda d: d - distance > NEARER_BY)


def heading_change(now: Column, new: Column) -> Column:
    """The smallest turn from one heading to another in degrees, -180 .. 180."""
    return geo.modulo(new - now + 180.0, 360.0) - 180.0


def bearing(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees from the x axis, 0 .. 360."""
    return geo.modulo(F.degrees(F.atan2(by - ay, bx - ax)) + 360.0, 360.0)


def count_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")


def in_front(a: Column, b: Column, margin: float = 0.1) -> Column:
    """'first' or 'second' by which mean depth is less; null if either is missing or they are too near each other."""
    return F.when(F.abs(a - b) >= margin * F.least(a, b), F.when(a < b, "first").otherwise("second"))


def _bits(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint8) != 0


@F.pandas_udf(DoubleType())
def mask_area(mask: pd.Series) -> pd.Series:
    """Set pixels of a mask, 0 for null."""
    return pd.Series([float(_bits(m).sum()) for m in mask], dtype="float64")


@F.pandas_udf(DoubleType())
def mask_intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pixels set in both masks; null if their sizes differ."""
    return pd.Series([float((x & y).sum()) if len(x) == len(y) else None for x, y in zip(map(_bits, a), map(_bits, b))], dtype="float64")


@F.pandas_udf(BinaryType())
def mask_union(a: pd.Series, b: pd.Series) -> pd.Series:
    """The mask of the pixels set in either; null if their sizes differ."""
    return pd.Series([(x | y).astype(np.uint8).tobytes() if len(x) == len(y) else None for x, y in zip(map(_bits, a), map(_bits, b))], dtype=object)


def mask_iou(a: Column, b: Column) -> Column:
    both = mask_intersection(a, b)
    return F.coalesce(F.try_divide(both, mask_area(a) + mask_area(b) - both), F.lit(0.0))


@F.pandas_udf(DoubleType())
def mean_depth(depths: pd.Series, mask: pd.Series) -> pd.Series:
    """Mean of the depths (little-endian floats) under a mask; null for an empty one or other sizes."""

    def one(d: bytes | None, m: bytes | None) -> float | None:
        values, bits = np.frombuffer(d or b"", "<f4"), _bits(m)
        return float(values[bits].mean()) if len(values) == len(bits) and bits.any() else None

    return pd.Series([one(d, m) for d, m in zip(depths, mask)], dtype="float64")


#: What a heading dot is like: hue within 10 of red (of 180), saturation and value from 150 (of 255).
RED_HUE, RED_LEAST = 10, 150


def red_dot(width: int, height: int, rgb: np.ndarray, cx: float, cy: float, radius: float) -> tuple[float, float] | None:
    """The centre of the red blob nearest to ``radius`` from (cx, cy), None without one.

    ``rgb``: height x width x 3. Blobs are 8-connected, of 4 pixels at least, no more than three times as
    long as wide, no larger than the radius and at most twice the radius away.
    """
    c = rgb.reshape(height, width, 3).astype(float)
    top, low = c.max(axis=2), c.min(axis=2)
    span = np.maximum(top - low, 1e-9)
    hue = np.where(top == c[..., 0], ((c[..., 1] - c[..., 2]) / span) % 6, 3.0) * 30
    red = (top == c[..., 0]) & ((hue <= RED_HUE) | (hue >= 180 - RED_HUE)) & (top >= RED_LEAST) & ((top - low) / np.maximum(top, 1e-9) * 255 >= RED_LEAST)
    left = set(map(tuple, np.argwhere(red)))
    best: tuple[float, float, float] | None = None
    while left:
        todo, blob = [left.pop()], []
        while todo:
            y, x = todo.pop()
            blob.append((y, x))
            near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in left]
            left.difference_update(near)
            todo += near
        p = np.array(blob)
        h, w = p.max(axis=0) - p.min(axis=0) + 1
        my, mx = p.mean(axis=0)
        away = math.hypot(mx - cx, my - cy)
        if len(blob) >= 4 and max(h, w) <= 3 * min(h, w) and max(h, w) <= radius and away <= 2 * radius:
            miss = abs(away - radius)
            if best is None or miss < best[0]:
                best = (miss, float(mx), float(my))
    return best[1:] if best else None
