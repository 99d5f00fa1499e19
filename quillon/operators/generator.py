"""Synthetic scenes: boxes of benches, stop signs, people, animals and a bus, laid out by rejection sampling.

A scene is drawn from its number alone, so that any task draws any scene again. Base scenes have signs
and benches on a jittered grid; variants add animals in rings around signs, people in arcs before benches
and a bus with a heading dot. Attempts that break a rule are drawn anew; a variant that never works out is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ensemble import greedy_match

# Canvas and sprite sizes in pixels, counts, radii and rules of scenes.
CANVAS, MARGIN, GRID, JITTER = (4032, 2268), 30, (3, 3), 0.25
SPRITES = {"bench": (568, 338), "stop sign": (220, 420), "person": (308, 574), "clock": (260, 260), "zebra": (330, 260), "elephant": (380, 320), "giraffe": (260, 420)}
SIGNS, BENCHES, ANIMALS, PEOPLE = (2, 3), (3, 5), (2, 5), (0, 3)
ANIMAL_RING, PEOPLE_RING, WIDTH_SCALE, ARC = 370.0, 300.0, 0.9, (0.2, 0.8)
PAD, TRIES, RING_TRIES, NEAR_SHARE, NEAR_GAP, BUS_APART, DOT = 30, 30, 100, 0.4, 190.0, 150.0, 215.0
BASE_SCENES, VARIANTS, LONGEST, BLANK = 420, 25, 1280, 8
SCENE = "scene bigint, variant int, det_idx int, label string, score double, x1 double, y1 double, x2 double, y2 double, img_w int, img_h int, dot_x double, dot_y double"
Box = tuple[float, float, float, float]


def overlaps(a: Box, b: Box, pad: float = 0.0) -> bool:
    """Whether boxes overlap when grown by ``pad`` each; touching ones don't."""
    return a[0] - pad < b[2] + pad and b[0] - pad < a[2] + pad and a[1] - pad < b[3] + pad and b[1] - pad < a[3] + pad


def on_canvas(b: Box, margin: float = MARGIN) -> bool:
    return b[0] >= margin and b[1] >= margin and b[2] <= CANVAS[0] - margin and b[3] <= CANVAS[1] - margin


def valid_layout(bs: list[Box], pad: float = PAD) -> bool:
    """All boxes on the canvas and no two overlapping."""
    return all(map(on_canvas, bs)) and not any(overlaps(a, b, pad) for i, a in enumerate(bs) for b in bs[:i])


def cells_apart(cells: list[int], columns: int = GRID[1]) -> bool:
    """No two grid cells in one column, and none next to each other, corners included."""
    at = [divmod(c, columns) for c in cells]
    return len({c for _, c in at}) == len(at) and all(max(abs(r - s), abs(c - d)) > 1 for i, (r, c) in enumerate(at) for s, d in at[:i])


def centred(cx: float, cy: float, label: str) -> Box:
    w, h = SPRITES[label]
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def gap(a: Box, b: Box) -> float:
    return math.hypot(max(0.0, b[0] - a[2], a[0] - b[2]), max(0.0, b[1] - a[3], a[1] - b[3]))


def base_scene(seed: int) -> list[tuple[str, Box]] | None:
    """Signs and benches in cells of the grid; None if no attempt keeps the rules."""
    rng = np.random.default_rng([seed, 1])
    ch, cw = CANVAS[1] / GRID[0], CANVAS[0] / GRID[1]
    for _ in range(TRIES):
        n, m = int(rng.integers(SIGNS[0], SIGNS[1] + 1)), int(rng.integers(BENCHES[0], BENCHES[1] + 1))
        cells = [int(c) for c in rng.permutation(GRID[0] * GRID[1])[: n + m]]
        if not cells_apart(cells[:n]):
            continue
        out = []
        for k, c in enumerate(cells):
            label = "stop sign" if k < n else "bench"
            r, q = divmod(c, GRID[1])
            dx, dy = rng.uniform(-JITTER, JITTER, 2)
            out.append((label, centred((q + 0.5 + dx) * cw, (r + 0.5 + dy) * ch, label)))
        if valid_layout([b for _, b in out]):
            return out
    return None


def ring(rng: np.random.Generator, centre: tuple[float, float], radius: float, labels: list[str], arc: tuple[float, float]) -> list[tuple[str, Box]] | None:
    """Sprites on a ring within ``arc`` (fractions of pi, clockwise from the right), each as far along it from the others as they are wide."""
    taken: list[tuple[float, float]] = []
    out = []
    for label in labels:
        half = WIDTH_SCALE * SPRITES[label][0] / 2 / radius
        for _ in range(RING_TRIES):
            angle = math.pi * float(rng.uniform(*arc))
            b = centred(centre[0] + radius * math.cos(angle), centre[1] + radius * math.sin(angle), label)
            clear = all(abs((angle - a + math.pi) % (2 * math.pi) - math.pi) >= half + h for a, h in taken)
            if clear and on_canvas(b, 0):
                taken.append((angle, half))
                out.append((label, b))
                break
        else:
            return None
    return out


def bus_pose(rng: np.random.Generator, placed: list[tuple[str, Box]]) -> tuple[Box, float] | None:
    """The bus's box and its heading from north, near a bench or animal in some variants, else anywhere free."""
    targets = [b for label, b in placed if label in ("bench", "zebra", "elephant", "giraffe")]
    near = rng.random() < NEAR_SHARE and targets
    for _ in range(RING_TRIES):
        if near:
            t = targets[int(rng.integers(len(targets)))]
            angle, away = rng.uniform(0, 2 * math.pi), rng.uniform(0, NEAR_GAP)
            w, h = (t[2] - t[0] + SPRITES["clock"][0]) / 2 + away, (t[3] - t[1] + SPRITES["clock"][1]) / 2 + away
            b = centred((t[0] + t[2]) / 2 + w * math.cos(angle), (t[1] + t[3]) / 2 + h * math.sin(angle), "clock")
            if gap(b, t) > NEAR_GAP:
                continue
        else:
            b = centred(rng.uniform(MARGIN, CANVAS[0] - MARGIN), rng.uniform(MARGIN, CANVAS[1] - MARGIN), "clock")
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        apart = all(math.hypot(cx - (o[0] + o[2]) / 2, cy - (o[1] + o[3]) / 2) >= BUS_APART for _, o in placed)
        if apart and on_canvas(b) and not any(overlaps(b, o) for _, o in placed):
            return b, float(rng.uniform(0, 2 * math.pi))
    return None


def dot_of(bus: Box, heading: float) -> tuple[float, float]:
    """The heading dot: DOT pixels before the middle of the bus."""
    return (bus[0] + bus[2]) / 2 - DOT * math.sin(heading), (bus[1] + bus[3]) / 2 - DOT * math.cos(heading)


def variant(seed: int, number: int) -> list[tuple] | None:
    """Rows (det_idx, label, score, x1, y1, x2, y2, img_w, img_h, dot_x, dot_y) of a variant of a base scene, brought to LONGEST pixels."""
    base = base_scene(seed)
    if base is None:
        return None
    rng = np.random.default_rng([seed, 2, number])
    for _ in range(5):
        placed, ok = list(base), True
        for label, b in base:
            at = ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
            if label == "stop sign":
                kinds = [("zebra", "elephant", "giraffe")[int(k)] for k in rng.integers(0, 3, int(rng.integers(ANIMALS[0], ANIMALS[1] + 1)))]
                more = ring(rng, at, ANIMAL_RING, kinds, (0.0, 2.0))
            else:
                more = ring(rng, at, PEOPLE_RING, ["person"] * int(rng.integers(PEOPLE[0], PEOPLE[1] + 1)), ARC)
            if more is None:
                ok = False
                break
            placed += more
        pose = bus_pose(rng, placed) if ok else None
        if pose is None:
            continue
        placed.append(("clock", pose[0]))
        f = LONGEST / max(CANVAS)
        w, h = (round(x * f) for x in CANVAS)
        dot = [x * f for x in dot_of(*pose)]
        return [(k, label, 1.0, *(float(int(x * f)) for x in b), w, h, *dot) for k, (label, b) in enumerate(placed)]
    return None


def scenes(spark: SparkSession, base: int = BASE_SCENES, variants: int = VARIANTS, seed: int = 0) -> DataFrame:
    """``SCENE`` rows of all variants of ``base`` scenes that work out, drawn in as many tasks as there are cores."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCENE.split(", ")]
        for b in batches:
            rows = [(int(s), int(v), *r) for s, v in zip(b.scene, b.variant) for r in variant(seed * 1_000_003 + int(s), int(v)) or ()]
            yield pd.DataFrame(rows, columns=names)

    numbers = spark.range(base * variants).select(F.floor(F.col("id") / variants).alias("scene"), (F.col("id") % variants).cast("int").alias("variant"))
    return numbers.mapInPandas(draw, SCENE)


def as_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections, images) of ``scenes`` as the question operators take them."""
    image = F.col("scene") * VARIANTS + F.col("variant")
    det = rows.select(image.alias("image_id"), "det_idx", "label", "score", "x1", "y1", "x2", "y2", "img_w", "img_h")
    images = rows.select(image.alias("image_id"), F.format_string("scene_%06d_%02d.png", "scene", "variant").alias("source_id"), "img_w", "img_h", "dot_x", "dot_y").distinct()
    return det, images


def is_blank(patch: np.ndarray) -> bool:
    """Whether no channel of a patch (height x width x channels) differs by more than BLANK."""
    flat = patch.reshape(-1, patch.shape[-1]).astype(int)
    return not len(flat) or int((flat.max(axis=0) - flat.min(axis=0)).max()) <= BLANK


def placement_ok(placed: DataFrame, found: DataFrame, iou: float = 0.30) -> DataFrame:
    """(image_id) whose found boxes are those placed: one clock, and per label as many found as placed, matched one to one.

    Both have (image_id, label, det_idx, x1..y2).
    """
    count = lambda df, name: df.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias(name))
    both = count(placed, "a").join(count(found, "b"), ["image_id", "label"], "full")
    matched = greedy_match(placed, found, iou).groupBy("image_id", "label").agg(F.count("found_idx").alias("m"))
    per = both.join(matched, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("m", F.lit(0)).alias("m"))
    ok = (F.col("a") == F.col("b")) & (F.col("m") == F.col("a"))
    return per.groupBy("image_id").agg(F.bool_and(ok).alias("ok"), F.coalesce(F.sum(F.when(F.col("label") == "clock", F.col("b"))), F.lit(0)).alias("clocks")).where("ok and clocks = 1").select("image_id")


def column_width(width: Column, ratio: float = 0.03) -> Column:
    """The width within which the generator counts points as one column; the questions' own is fixed."""
    return F.greatest(F.lit(24.0), width * ratio)


