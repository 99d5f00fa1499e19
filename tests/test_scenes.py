"""Hand-made scenes on a canvas of 1280 x 720 with the answers that follow from the rules."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import box_questions as B
from quillon.operators import ensemble
from quillon.operators.scene_questions import REGISTRY
from quillon.operators.scenes import boxes, scenes

DET = "image_id bigint, img_w int, img_h int, det_idx int, label string, cls int, score double, x1 double, y1 double, x2 double, y2 double"
BASE = [("clock", 600, 300, 680, 380), ("bench", 100, 300, 200, 360), ("bench", 900, 300, 1000, 360), ("person", 110, 200, 140, 280)]


def image(k, items, score=0.9):
    return [(k, 1280, 720, i, lab, 0, score, float(a), float(b), float(c), float(d)) for i, (lab, a, b, c, d) in enumerate(items)]


def det(spark, *images):
    return spark.createDataFrame([r for k, items in enumerate(images) for r in image(k, items)], DET)


def ask(spark, name, *images, dots=None):
    heads = spark.createDataFrame(dots, "image_id bigint, dot_x double, dot_y double") if dots else None
    rows = REGISTRY[name][1](scenes(boxes(det(spark, *images)), heads or spark.createDataFrame([], "image_id bigint, dot_x double, dot_y double"))).collect()
    return sorted((r.image_id, r.target, r.answer) for r in rows)


@pytest.mark.parametrize(
    "name, want",
    [
        ("count_people", [(0, 0, "1")]),
        ("people_at_bench", [(0, 1, "1"), (0, 2, "0")]),
        ("list_benches_k", [(0, 1, "1"), (0, 2, "0")]),
        ("closest_bench", [(0, 0, "2")]),
        ("closest_bench_with_person", [(0, 0, "1")]),
        ("count_at_closest_bench", [(0, 0, "0")]),
        ("order_benches", [(0, 0, "2, 1")]),
        ("direction_bench", [(0, 1, "West"), (0, 2, "East")]),
        ("avoid_to_bench", [(0, 1, "keep straight"), (0, 2, "keep straight")]),
    ],
)
def test_base_scene(spark, name, want):
    assert ask(spark, name, BASE) == want


def test_without_people_counts_are_zero(spark):
    assert ask(spark, "closest_bench_with_person", BASE[:3]) == [(0, 0, "0")]
    assert ask(spark, "people_at_bench", BASE[:3]) == [(0, 1, "0"), (0, 2, "0")]


def test_equal_distances_and_halfway_people_have_no_answer(spark):
    even = [BASE[0], ("bench", 300, 300, 400, 360), ("bench", 880, 300, 980, 360)]
    assert ask(spark, "closest_bench", even) == []
    half = [*BASE[:3], ("person", 540, 300, 560, 360)]
    assert ask(spark, "people_at_bench", half) == []
    assert ask(spark, "count_people", half) == [(0, 0, "1")]


def test_numbering_follows_the_running_mean(spark):
    # Centres 100, 135 and 170: the third is 52.5 from the mean of the first two.
    rows = [BASE[0], ("bench", 90, 500, 110, 520), ("bench", 125, 100, 145, 120), ("bench", 160, 300, 180, 320), ("person", 125, 130, 145, 160)]
    assert ask(spark, "people_at_bench", rows) == [(0, 1, "1"), (0, 2, "0"), (0, 3, "0")]


def test_turns_and_sides_need_the_dot(spark):
    assert ask(spark, "turn_bench", BASE) == []
    assert ask(spark, "turn_bench", BASE, dots=[(0, 700.0, 340.0)])[1] == (0, 2, "already facing")
    assert ask(spark, "heading", BASE, dots=[(0, 700.0, 340.0)]) == [(0, 0, "East")]


def test_an_obstacle_on_the_line_is_too_close_to_call(spark):
    on_line = [("clock", 600, 100, 640, 140), ("bench", 600, 600, 640, 640), ("stop sign", 600, 300, 640, 340)]
    assert ask(spark, "avoid_to_bench", on_line) == []


def test_an_obstacle_to_the_right_turns_the_bus_left(spark):
    way = [("clock", 600, 100, 680, 180), ("bench", 620, 600, 660, 640), ("stop sign", 500, 220, 630, 260)]
    assert ask(spark, "avoid_to_bench", way) == [(0, 1, "turn left")]


def answers(df):
    return sorted((r.image_id, r.subject, r.answer) for r in df.collect())


def test_counts(spark):
    cars = [("car", i, 0, i + 5, 5) for i in range(4)]
    people = [("person", 50 + i, 50, 60 + i, 60) for i in range(2)]
    d = boxes(det(spark, [*cars, *people, ("dog", 100, 100, 110, 110)]))
    assert answers(B.most(d)) == [(0, "", "car")]
    assert answers(B.least(d)) == [(0, "", "dog")]
    assert answers(B.are_more(d)) == [(0, "car/dog", "Yes"), (0, "car/person", "Yes"), (0, "person/dog", "Yes")]
    assert answers(B.which_more(d)) == [(0, "car/person/dog", "cars")]
    one = boxes(det(spark, [("dog", 0, 0, 10, 10)]))
    assert answers(B.less_than(one)) == [(0, "dog/0", "Yes"), (0, "dog/2", "Yes")]
    assert answers(B.more_than(one)) == [(0, "dog/1", "Yes"), (0, "dog/2", "No")]


def test_ties_are_not_asked(spark):
    d = boxes(det(spark, [("car", i, 0, i + 5, 5) for i in range(3)] + [("person", i, 50, i + 5, 60) for i in range(3)]))
    assert answers(B.most(d)) == [] and answers(B.are_more(d)) == []
    assert answers(B.how_many(d)) == [(0, "car", "3"), (0, "person", "3")]


def test_multi_choice_has_the_middle_range_right(spark):
    (r,) = B.multi_choice(boxes(det(spark, [("car", i, 0, i + 5, 5) for i in range(5)]))).collect()
    assert r.subject.split("/")["ABC".index(r.answer) + 1] == "3-7"


def test_rows_clusters_and_matching(spark):
    row = [("a", 100 * i, 100, 100 * i + 10, 110) for i in range(4)]
    assert answers(B.objects_in_row(boxes(det(spark, row)))) == [(0, "", "Yes")]
    tight = [("a", 10 + i, 10, 20 + i, 20) for i in range(5)] + [("b", 600 + 9 * i, 600, 610 + 9 * i, 610) for i in range(5)] + [("c", 1200, 10, 1210, 20)]
    got = answers(B.most_clustered(boxes(det(spark, tight))))
    assert [x[1].split("/")["ABC".index(x[2])] for x in got] == ["a"]
    d = boxes(det(spark, row))
    m = ensemble.greedy_match(d, d.where("det_idx < 3")).collect()
    assert sorted((r.placed_idx, r.found_idx) for r in m if r.found_idx is not None) == [(0, 0), (1, 1), (2, 2)]


def test_fusion_means_boxes_by_score(spark):
    d = det(spark, [("a", 0, 0, 10, 10), ("a", 0, 0, 10, 12), ("a", 50, 50, 60, 60)]).withColumn("model", F.concat(F.lit("m"), F.col("det_idx").cast("string")))
    out = sorted(ensemble.weighted_fusion(d, {"m0": 1, "m1": 1, "m2": 1}).collect(), key=lambda r: r.x1)
    assert [(r.members, round(r.y2, 6)) for r in out] == [(2, 11.0), (1, 60.0)]


def test_dirty_and_empty_boxes(spark):
    rows = [(1, 1280, 720, 0, " Stop_Sign ", 0, 0.9, 10.0, 10.0, 5.0, 5.0), (1, 1280, 720, 0, " Stop_Sign ", 0, 0.9, 10.0, 10.0, 5.0, 5.0), (1, 1280, 720, 1, None, 0, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 1280, 720, 2, "bench", 0, None, 0.0, 0.0, 1.0, 1.0), (1, 1280, 720, 3, "bench", 0, 0.1, 0.0, 0.0, 1.0, 1.0), (None, 1280, 720, 4, "bench", 0, 0.9, 0.0, 0.0, 1.0, 1.0)]
    (r,) = boxes(spark.createDataFrame(rows, DET)).collect()
    assert (r.label, r.x1, r.x2) == ("stop sign", 5.0, 10.0)
    for name, (_, build) in REGISTRY.items():
        assert build(scenes(boxes(spark.createDataFrame([], DET)), spark.createDataFrame([], "image_id bigint, dot_x double, dot_y double"))).count() == 0, name
