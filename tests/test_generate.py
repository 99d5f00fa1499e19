import pytest

from quillon.operators import generate as G
from quillon.operators.scenes import boxes, scenes

BOXES = "image_id bigint, det_idx int, img_w int, img_h int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def det(spark, *images):
    rows = [(i, k, 1280, 720, label, 0.9, *map(float, box)) for i, image in enumerate(images) for k, (label, *box) in enumerate(image)]
    return spark.createDataFrame(rows, BOXES)


ONE = [("clock", 600, 300, 680, 380), ("bench", 100, 300, 200, 360), ("bench", 900, 300, 1000, 360), ("person", 110, 200, 140, 280)]


def images(spark, n=2):
    return spark.createDataFrame([(i, f"s{i}.png", None, None) for i in range(n)], "image_id bigint, source_id string, dot_x double, dot_y double")


def test_rows_of_a_configuration(spark):
    asked = [{"name": "ClosestBench"}, {"name": "Nonsense"}, {"name": "ArrivedAtBench", "params": {"dist_threshold": 5000}}, {"name": "ArrivedAtBench", "params": {"wrong": 1}}, {"name": "HowMany"}, {"name": "Closer"}]
    rows = [tuple(r) for r in G.qa_rows(det(spark, ONE, ONE[:1]), images(spark), asked).orderBy("id").collect()]
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert [(r[2], r[3], r[5]) for r in rows] == [("s0.png", "ClosestBench", "2"), ("s0.png", "ArrivedAtBench", "Yes"), ("s0.png", "ArrivedAtBench", "Yes"), ("s0.png", "HowMany", "2"), ("s0.png", "HowMany", "1"), ("s0.png", "HowMany", "1"), ("s1.png", "HowMany", "1")]
    assert "bench number 2?" in rows[2][4] and rows[3][4] == "How many bench(s) are there in this image?"
    with pytest.raises(ValueError):
        G.qa_rows(det(spark, ONE), images(spark), [{"name": "Nonsense"}])
    assert G.qa_rows(det(spark, ONE).limit(0), images(spark)).count() == 0


def test_one_pass_gives_what_single_questions_give(spark):
    s = scenes(boxes(det(spark, ONE, ONE[:3], ONE + [("zebra", 300, 500, 400, 560), ("stop sign", 320, 420, 360, 470)])), images(spark, 3))
    got = {(r.image_id, r.question_type, r.item, r.answer) for r in G.scene_rows(s, G.configured()).collect()}
    want = {(r.image_id, kind, r.target, r.answer) for kind, build in G.S.REGISTRY.values() for r in build(s).collect()}
    assert got == want and len({k for _, k, _, _ in got}) > 10


def test_sentences_name_what_they_ask(spark):
    rows = {r.question for r in G.qa_rows(det(spark, ONE + [("person", 120, 210, 150, 290)] * 3), images(spark), [{"name": n} for n in ("PairwiseCloserBench", "MoreThanThresholdHowMany", "LessThanThresholdHowMany", "MultiChoiceHowMany", "WhichMore")]).collect()}
    assert any("bench #1 or bench #2?" in q for q in rows) and "Are there any clock(s) in this image? Respond Yes/No." in rows and "Are there 2 or more person(s) in this image? Respond Yes/No." in rows
    assert any(q.startswith("How many person(s) are in the image? Choose one: A) ") for q in rows) and not any("{" in q for q in rows)


def test_predicates(spark):
    d = boxes(det(spark, ONE, [("person", 0, 0, 10, 10), ("person", 30, 0, 40, 10)], [("person", 0, 0, 10, 10), ("person", 90, 0, 100, 10)]))
    ids = lambda df: sorted(r.image_id for r in df.collect())
    assert ids(G.at_least_one_single(d)) == [0] and ids(G.at_least_classes(3)(d)) == [0] and ids(G.at_least_boxes(4)(d)) == [0]
    assert ids(G.has_clusters(50.0)(d)) == [1] and ids(G.apart(d)) == [0]
    assert ids(G.applicable(d, [])) == ids(d.select("image_id")) and ids(G.applicable(d, [G.apart, G.at_least_boxes(9)])) == []
    assert ids(G.first_images(d, 1, 2).select("image_id").distinct()) == [0, 1]


def test_labels_and_categories(spark):
    assert G.validate_labels([]) == (True, None) and not G.validate_labels(["undefined", "dog"])[0]
    assert len(G.CATEGORY_NAMES) == 80
    row = spark.sql("select 'clock' a, 11 b, 80 c, -1 d, 'blob' e").select(G.category_id(G.F.col("a")), G.category_name(G.F.col("b")), G.category_name(G.F.col("c")), G.category_name(G.F.col("d")), G.category_id(G.F.col("e"))).first()
    assert tuple(row) == (74, "stop sign", "undefined", "undefined", None)


def test_context_of_an_image(spark):
    r = G.question_context(boxes(det(spark, ONE))).first()
    assert r.areas[0] == 6400 and r.by_class["bench"] == [1, 2] and r.centers[1] == [150.0, 330.0]
