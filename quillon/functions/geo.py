"""Box and direction geometry as column expressions; no Python runs per row.

Image coordinates: x to the right, y downwards. Distances and margins are scaled by the longer side
of the image over 4032 pixels, as the constants below were set at that size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference side in pixels, and margins at that size.
REFERENCE_SIDE = 4032.0
ARRIVAL_MARGIN, PATH_MARGIN, ASSIGN_MARGIN, DISTANCE_MARGIN, LEAST_MARGIN = 35.0, 65.0, 80.0, 80.0, 8.0
ENTRY_GAP = 0.04
HEAD_ON = math.pi / 18
SECTOR_MARGIN, RELATIVE_MARGIN, TURN_MARGIN = math.pi / 36, math.pi / 18, math.pi / 18
COMPASS = ["East", "Southeast", "South", "Southwest", "West", "Northwest", "North", "Northeast"]
RELATIVE = ["front", "front-right", "right", "back-right", "back", "back-left", "left", "front-left"]


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def scale(w: Column, h: Column) -> Column:
    """Longer side over the reference side, 1 for an empty image."""
    side = F.greatest(w, h) / F.lit(REFERENCE_SIDE)
    return F.when(side > 0, side).otherwise(F.lit(1.0))


def margin(size: float, s: Column) -> Column:
    return F.greatest(F.lit(LEAST_MARGIN), F.lit(size) * s)


def gap_between(a: Column, b: Column) -> Column:
    """Distance between the edges of two boxes, 0 where they overlap."""
    dx = F.greatest(F.lit(0.0), b["x1"] - a["x2"], a["x1"] - b["x2"])
    dy = F.greatest(F.lit(0.0), b["y1"] - a["y2"], a["y1"] - b["y2"])
    return F.sqrt(dx * dx + dy * dy)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes without overlap or area."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def entry_t(px: Column, py: Column, qx: Column, qy: Column, box: Column, by: Column | float = 0.0) -> Column:
    """Where, from 0 to 1, the segment p to q enters ``box`` grown by ``by``; null if it doesn't."""
    by = by if isinstance(by, Column) else F.lit(by)
    dx, dy = qx - px, qy - py
    x1, x2, y1, y2 = box["x1"] - by, box["x2"] + by, box["y1"] - by, box["y2"] + by
    ax, bx = F.try_divide(x1 - px, dx), F.try_divide(x2 - px, dx)
    ay, by_ = F.try_divide(y1 - py, dy), F.try_divide(y2 - py, dy)
    low = F.greatest(F.lit(0.0), F.coalesce(F.least(ax, bx), F.lit(0.0)), F.coalesce(F.least(ay, by_), F.lit(0.0)))
    high = F.least(F.lit(1.0), F.coalesce(F.greatest(ax, bx), F.lit(1.0)), F.coalesce(F.greatest(ay, by_), F.lit(1.0)))
    inside = ((dx != 0) | px.between(x1, x2)) & ((dy != 0) | py.between(y1, y2))
    return F.when(inside & (low <= high), low)


def wrapped(angle: Column) -> Column:
    """An angle between -2 pi and 2 pi, brought to -pi .. pi."""
    return F.when(angle > math.pi, angle - 2 * math.pi).when(angle <= -math.pi, angle + 2 * math.pi).otherwise(angle)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle from a to b; positive is clockwise on the screen."""
    return wrapped(F.atan2(by, bx) - F.atan2(ay, ax))


def modulo(a: Column, m: float) -> Column:
    """a modulo m, never negative."""
    return a - F.floor(a / m) * m


def sector(angle: Column, names: list[str]) -> Column:
    """The name of the nearest of eight directions; halves go to the even one."""
    k = F.pmod(F.rint(angle / (math.pi / 4)).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(n) for n in names]), k + 1)


def sector_is_stable(angle: Column, edge: float, width: float = math.pi / 4) -> Column:
    """True if an angle is farther than ``edge`` from the border of its sector."""
    r = modulo(angle + width / 2, width)
    return F.least(r, F.lit(width) - r) > edge


def turn(delta: Column) -> Column:
    return F.when(F.abs(delta) <= math.pi / 8, "already facing").when(delta > 0, "turn right").otherwise("turn left")


def turn_is_stable(delta: Column) -> Column:
    return F.abs(F.abs(delta) - math.pi / 8) > TURN_MARGIN
