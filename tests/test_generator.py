import math

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import generate
from quillon.operators import generator as N
from quillon.operators.scenes import left_to_right


def test_layouts_keep_their_rules():
    made = [N.base_scene(k) for k in range(60)]
    good = [m for m in made if m]
    assert len(good) > 20
    for m in good:
        signs, benches = ([b for label, b in m if label == kind] for kind in ("stop sign", "bench"))
        assert 2 <= len(signs) <= 3 and 3 <= len(benches) <= 5 and N.valid_layout([b for _, b in m])
    assert N.cells_apart([0, 5]) and not N.cells_apart([0, 3]) and not N.cells_apart([0, 4]) and not N.cells_apart([0, 6])
    assert N.base_scene(3) == N.base_scene(3)


def test_variants_have_one_bus_and_its_dot():
    rows = next(v for k in range(60) if (v := N.variant(k, 0)))
    bus = [r for r in rows if r[1] == "clock"]
    assert len(bus) == 1 and rows[0][7:9] == (1280, 720)
    cx, cy = (bus[0][3] + bus[0][5]) / 2, (bus[0][4] + bus[0][6]) / 2
    assert abs(math.hypot(rows[0][9] - cx, rows[0][10] - cy) - N.DOT * 1280 / 4032) < 2
    assert N.dot_of((0, 0, 2, 2), 0.0) == (1.0, 1.0 - N.DOT)


def test_scenes_make_questions(spark):
    rows = N.scenes(spark, 8, 3)
    assert rows.exceptAll(N.scenes(spark, 8, 3).repartition(5)).count() == 0
    det, images = N.as_tables(rows)
    assert images.count() == det.select("image_id").distinct().count() > 3
    qa = generate.qa_rows(det, images)
    assert qa.select("question_type").distinct().count() > 20
    assert N.placement_ok(det, det).count() == images.count()
    moved = det.withColumn("x1", F.when(F.col("label") == "clock", F.col("x1") + 500).otherwise(F.col("x1"))).withColumn("x2", F.when(F.col("label") == "clock", F.col("x2") + 500).otherwise(F.col("x2")))
    assert N.placement_ok(det, moved).count() == 0 and N.placement_ok(det, det.where("label <> 'bench' or det_idx > 3")).count() == 0


def test_blank_patches_and_column_widths(spark):
    patch = np.full((4, 4, 3), 100)
    assert N.is_blank(patch)
    patch[0, 0, 1] = 109
    assert not N.is_blank(patch) and N.is_blank(np.zeros((0, 0, 3)))
    pts = [(0, 100.0, 9.0), (1, 126.0, 1.0), (2, 160.0, 5.0)]
    df = spark.createDataFrame([(1280, [dict(det_idx=i, cx=x, cy=y, x1=x, y1=y, x2=x, y2=y) for i, x, y in pts])], "w int, p array<struct<det_idx:int,cx:double,cy:double,x1:double,y1:double,x2:double,y2:double>>")
    r = df.select(left_to_right(F.col("p")), left_to_right(F.col("p"), N.column_width(F.col("w")))).first()
    assert [b.det_idx for b in r[0]] == [1, 0, 2] and [b.det_idx for b in r[1]] == [1, 0, 2]
    assert df.select(N.column_width(F.lit(100)), N.column_width(F.lit(1280))).first()[:] == (24.0, 38.4)
