"""Boxes matched and fused as one stream per task: against loops, in groups small and large, with ties and missing sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ensemble
from quillon.operators import exports as X
from quillon.plans import core

BOX = "image_id bigint, label string, det_idx int, score double, x1 double, y1 double, x2 double, y2 double"


def some_boxes(seed, sizes):
    """Boxes of an image per size, with equal scores and boxes among them."""
    rng, rows = np.random.default_rng(seed), []
    for i, n in enumerate(sizes):
        for k in range(n):
            x, y, w, h = (float(v) for v in rng.integers(0, 60, 2).tolist() + rng.integers(0, 25, 2).tolist())
            rows.append((None if i == 0 else i, "ab"[k % 2], k, float(rng.integers(3, 9)) / 10, x, y, x + w, y + h))
    return rows


def iou(a, b):
    w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
    total = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h
    return w * h / total if total > 0 else 0.0


def by_loop(takers, givers, least):
    """(image, label, taker) to (giver, iou), takers in the given order."""
    out, free = {}, sorted(givers, key=lambda r: r[2])
    for t in takers:
        own = [g for g in free if g[:2] == t[:2]]
        best = max(own, key=lambda g: iou(t, g), default=None)
        out[t[:3]] = (best[2], iou(t, best)) if best and iou(t, best) >= least else None
        if out[t[:3]]:
            free.remove(best)
    return out


def per_batch(df):
    """Whether Python is called per batch; a call per group takes hours for millions of groups."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "GroupsInPandas" not in plan


@pytest.fixture(scope="module")
def sides():
    return some_boxes(1, [5, 0, 7, 3, 90, 200, 1] + [4] * 40), some_boxes(2, [4, 3, 9, 0, 70, 210, 1] + [5] * 40)


def test_average_precision_calls_python_per_batch(spark, sides):
    truth, found = sides
    got = X.matched_boxes(spark.createDataFrame(truth, BOX), spark.createDataFrame(found, BOX), 0.3)
    want = by_loop(sorted(found, key=lambda r: (-r[3], r[2])), truth, 0.3)
    assert {(r.image_id, r.label, r.det_idx): r.hit for r in got.collect()} == {k: int(v is not None) for k, v in want.items()} and 0 < sum(map(bool, want.values())) < len(want)
    assert per_batch(X.average_precision(spark.createDataFrame(truth, BOX), spark.createDataFrame(found, BOX)))
    bad = spark.createDataFrame([(1, "a", 0, float("nan"), 0.0, 0.0, 9.0, 9.0), (1, "a", 1, None, 0.0, 0.0, 9.0, 9.0), (1, "a", 2, 0.1, 0.0, 0.0, 9.0, 9.0), (1, "a", 3, 0.9, None, 0.0, 9.0, 9.0)], BOX)
    assert {r.det_idx: r.hit for r in X.matched_boxes(bad.where("det_idx = 2"), bad).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_placed_boxes_take_found_ones_per_batch(spark, sides):
    placed, found = sides
    got = ensemble.greedy_match(spark.createDataFrame(placed, BOX), spark.createDataFrame(found, BOX))
    want = by_loop(sorted(placed, key=lambda r: r[2]), found, 0.3)
    assert {(r.image_id, r.label, r.placed_idx): (r.found_idx, r.iou) for r in got.collect()} == {k: v or (None, 0.0) for k, v in want.items()}
    assert per_batch(got)
    assert ensemble.greedy_match(spark.createDataFrame([], BOX), spark.createDataFrame(found, BOX)).count() == 0


def test_fusion_calls_python_per_batch(spark, sides):
    rows = [(*r, f"m{k % 3}") for k, r in enumerate(sides[1])]
    weights = {"m0": 2.0, "m1": 1.0, "m2": 0.5}
    got = ensemble.weighted_fusion(spark.createDataFrame(rows, f"{BOX}, model string"), weights)
    want = {}
    for r in sorted(rows, key=lambda r: (-r[3] * weights[r[8]], *r[4:8], r[8])):
        fused = want.setdefault(r[:2], [])
        at = max(fused, key=lambda f: iou(r, (0, 0, 0, 0, *f[0])), default=None)
        if at is None or iou(r, (0, 0, 0, 0, *at[0])) <= 0.55:
            at = [None, []]
            fused.append(at)
        at[1].append((r[4:8], r[3] * weights[r[8]]))
        at[0] = tuple(np.average([b for b, _ in at[1]], axis=0, weights=[w for _, w in at[1]]))
    flat = [(k[0], k[1], len(m), *np.round((np.mean([w for _, w in m]) * min(len(m), 3) / 3.5, *b), 6)) for k, fused in want.items() for b, m in fused]
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(((r.image_id, r.label, r.members, *np.round((r.score, r.x1, r.y1, r.x2, r.y2), 6)) for r in got.collect()), key=key) == sorted(flat, key=key) and max(r[2] for r in flat) >= 3
    assert per_batch(got)


def test_image_measures_call_python_per_batch(spark, sides):
    truth, found = (spark.createDataFrame([r for r in rows if r[0] is not None], BOX) for rows in sides)
    got = X.image_measures(truth, found)
    assert per_batch(got)
    hits = [k for k, v in by_loop(sorted(sides[1], key=lambda r: (-r[3], r[2])), sides[0], 0.5).items() if v]
    for r in got.collect():
        n = sum(k[0] == r.image_id for k in hits)
        assert (r.hits, r.false_alarms, r.missed) == (n, sum(b[0] == r.image_id for b in sides[1]) - n, sum(b[0] == r.image_id for b in sides[0]) - n)


def test_image_measures_shuffle_boxes_once(spark):
    plan = core.QUERIES["image_measures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan  # boxes by image; neither sides nor hits are shuffled again


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_marked_measures_match_many_images_at_once(spark, batch):
    rows = [r for seed in (3, 4, 5) for r in some_boxes(seed, [30, 0, 170, 3, 1] + [12] * 20)]  # in places three boxes of one det_idx
    rows = [(r[0], r[1] if k % 5 else None, r[2], (None, float("nan"))[k % 2] if k % 11 == 0 else r[3], *r[4:], k % 3 > 0, k % 4 > 0) for k, r in enumerate(rows)]
    order = lambda r: (r[2], *r[4:8])
    want = {}
    for i in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == i]
        free, found, hits = sorted((r for r in own if r[8]), key=order), [r for r in own if r[9]], 0
        for f in sorted(found, key=lambda r: (r[3] is None or r[3] != r[3], 0 if r[3] is None or r[3] != r[3] else -r[3], order(r))):
            best = max((t for t in free if t[1] == f[1]), key=lambda t: iou(f, t), default=None)
            if best and iou(f, best) >= 0.5:
                free.remove(best)
                hits += 1
        want[i] = (hits, len(found) - hits, len(free))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = X.marked_measures(spark.createDataFrame(rows, f"{BOX}, true boolean, found boolean")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and {r.image_id: tuple(r)[1:] for r in got} == want and 0 < sum(h for h, _, _ in want.values())
    assert max(sum(1 for r in rows if r[:2] == k and r[8]) * sum(1 for r in rows if r[:2] == k and r[9]) for k in {r[:2] for r in rows}) > ensemble.MANY  # box by box, too


def test_takers_are_served_alike_by_box_by_piece_and_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    group = rng.integers(0, 40, 600)
    low = rng.integers(0, 20, (600, 2))
    corners = np.hstack([low, low + rng.integers(1, 25, (600, 2))]).astype(float)
    args = (group, rng.random(600) < 0.8, rng.random(600) < 0.8, rng.integers(3, 9, 600) / 10, rng.integers(0, 9, 600), corners, 0.3)
    want = ensemble.takers_served(*args)
    assert 0 < want.sum() < args[1].sum() and not (want & ~args[1]).any()
    for name, value in (("AT_ONCE", 1), ("MANY", 0)):
        monkeypatch.setattr(ensemble, name, value)
        assert (ensemble.takers_served(*args) == want).all()
    assert not len(ensemble.takers_served(*[x[:0] for x in args[:-1]], 0.3))
