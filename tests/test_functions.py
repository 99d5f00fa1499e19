"""Boxes, prompts, robot replies, samples and metrics on small cases."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions import prompts as P
from quillon.functions import robot as R
from quillon.operators import evaluation as E
from quillon.operators import samples as S
from quillon.sources import annotations as A


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def box(*b):
    return F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(b, ("x1", "y1", "x2", "y2"))])


def test_forms_of_boxes(spark):
    r = one(spark, B.relative_top_left(box(10, 20, 30, 60), F.lit(100), F.lit(200)).alias("a"), B.from_centre(*map(F.lit, (20.0, 40.0, 20.0, 40.0))).alias("b"), B.letterboxed(box(0, 0, 100, 50), F.lit(100), F.lit(50), 200, 200).alias("c"), B.resized(F.lit(2000), F.lit(999), 1280).alias("d"), B.resized(F.lit(20), F.lit(9), 1280).alias("e"))
    assert tuple(r.a) == (0.1, 0.1, 0.2, 0.2) and tuple(r.b) == (10, 20, 30, 60) and tuple(r.c) == (0, 50, 200, 150) and tuple(r.d) == (1280, 639) and tuple(r.e) == (20, 9)


def test_places_of_boxes(spark):
    a, b = box(0, 0, 10, 10), box(10, 0, 20, 10)
    r = one(spark, B.overlap(a, b), B.overlap(a, b, 1.0), B.point_gap(F.lit(13.0), F.lit(14.0), a), B.inside(box(-2, 0, 5, 5), F.lit(5), F.lit(5)), B.inside(box(-2, 0, 5, 5), F.lit(5), F.lit(5), 2.0), B.union_box(F.array(a, b)))
    assert tuple(r[:5]) == (False, True, 5.0, False, True) and tuple(r[5]) == (0, 0, 20, 10)
    r = one(spark, B.heading_change(F.lit(350.0), F.lit(10.0)), B.heading_change(F.lit(10.0), F.lit(350.0)), B.bearing(*map(F.lit, (0.0, 0.0, 0.0, -1.0))), B.clearly_nearest(F.lit(10.0), F.array(F.lit(91.0))), B.clearly_nearest(F.lit(10.0), F.array(F.lit(90.0))), B.angle_is_clear(*map(F.lit, (1.0, 0.0, 1.0, 0.4))), B.in_front(F.lit(1.0), F.lit(1.05)), B.in_front(F.lit(2.0), F.lit(1.0)), B.in_front(F.lit(None).cast("double"), F.lit(1.0)))
    assert tuple(r) == (20, -20, 270, True, False, True, None, "second", None)


def test_masks(spark):
    df = spark.createDataFrame([(b"\1\1\0\0", b"\0\1\1\0", np.array([1, 2, 3, 4], "<f4").tobytes()), (None, b"\0", b""), (b"\0\0\0\0", b"\1\0\0\0", b"")], "a binary, b binary, d binary")
    got = df.select(B.mask_area("a"), B.mask_intersection("a", "b"), B.mask_union("a", "b"), B.mask_iou(F.col("a"), F.col("b")), B.mean_depth("d", "b")).collect()
    assert (got[0][0], got[0][1], bytes(got[0][2]), got[0][4]) == (2, 1, b"\1\1\1\0", 2.5) and abs(got[0][3] - 1 / 3) < 1e-9
    assert got[1][:3] == (0.0, None, None) and got[2][3] == 0 and got[2][4] is None


def test_red_dot():
    image = np.full((60, 60, 3), 90, np.uint8)
    image[28:32, 48:52] = (220, 20, 20)
    image[2:4, 2:4] = (220, 20, 20)
    assert B.red_dot(60, 60, image, 30.0, 30.0, 20.0) == (49.5, 29.5)
    assert B.red_dot(60, 60, np.zeros((60, 60, 3), np.uint8), 30.0, 30.0, 20.0) is None


def test_prompts(spark):
    r = one(spark, P.choice_question(F.array(F.lit("a"), F.lit("b"))), P.eval_question("robospatial", F.lit("points"), F.lit(" Where? ")), P.caption_question(F.lit("x")), F.size(P.messages(F.lit("q"), F.lit(" a "))), P.messages(F.lit("q"), F.lit(" a "))[1]["text"], F.size(P.messages(F.lit("q"), F.lit(None).cast("string"))))
    assert r[0] == "Which caption best describes the image?\n\nA. a\nB. b\n\nAnswer with the letter only." and r[1].endswith("\nQuestion: Where?") and "tuples" in r[1] and r[2].splitlines()[1] == 'Sentence: "x"' and r[3:] == (2, "a", 1)
    r = one(spark, P.strategy("passthrough", F.lit("q")), P.strategy("zero_shot", F.lit("q")), P.strategy("few_shot", F.lit("q"), [("i", "o")]))
    assert len(r[0]) == 1 and "backticks" in r[1][0].text and [m.role for m in r[2]] == ["system", "user", "assistant", "user"]
    for name in ("few_shot", "nonsense"):
        with pytest.raises(ValueError):
            P.strategy(name, F.lit("q"))


def test_commands(spark):
    r = one(spark, R.reply_to_commands(F.lit("Turn_left now")), R.turn_commands(F.lit("already facing")), R.side_commands(F.lit("back")), R.compass_commands(F.lit("North"), F.lit("South")), R.compass_commands(F.lit("East"), F.lit("North")), R.compass_commands(F.lit("East"), F.lit("Nowhere")), R.compass_commands(F.lit("East"), F.lit("East")))
    assert [list(x) for x in r] == [["l,10,15", "f,10,5"], [], ["l,10,15"], ["r,10,15"], ["l,10,15"], [], ["f,10,5"]]


def test_observations_and_ids(spark):
    r = one(spark, R.observation(F.lit("ArrivedAtBench"), F.lit(" Yes ")), R.observation(F.lit("CountPeople"), F.lit("some 3")), R.observation(F.lit("CountPeople"), F.lit("none")), R.observation(F.lit("ClosestBench"), F.lit("?")), R.observation(F.lit("ClosestToFurthestBenches"), F.lit("2, 1")), R.observation(F.lit("other"), F.lit("North")))
    assert [(x.flag, x.number, x.list, x.text) for x in r] == [(True, None, None, None), (True, 3, None, None), (False, None, None, None), (None, -1, None, None), (None, None, [2, 1], None), (None, None, None, "north")]
    answers = F.array(F.struct(F.lit(3).alias("i"), F.lit(1).alias("j"), F.lit(1).alias("answer")), F.struct(F.lit(1).alias("i"), F.lit(2).alias("j"), F.lit(9).alias("answer")))
    r = one(spark, R.clean_ids(F.array(*map(F.lit, (3, 0, 1, 3, -2)))), R.tournament(F.array(*map(F.lit, (3, 0, 1, 2))), answers), R.tournament(F.array(F.lit(0)), answers))
    assert tuple(r) == ([3, 1], 1, None)


def test_checks_and_lists(spark):
    r = one(spark, R.confirms(F.lit("```yes```")), R.confirms(F.lit("No, yes")), R.confirms(F.lit(None).cast("string")), R.listed(F.lit("""["a b", 'c', 3]""")), R.listed(F.lit("'x'")), R.listed(F.lit("nothing here")), R.listed(F.lit("```['q']```")))
    assert tuple(r) == (True, False, False, ["a b", "c", "3"], ["x"], [], ["q"])
    r = one(spark, R.answer_class(F.lit("Does the leftmost object in it appear to be wider than it is tall?")), R.answer_class(F.lit("What is the leftmost object?")), R.answer_class(F.lit("Why?")), R.file_name(F.lit(3), F.lit("a/b.png")), R.file_name(F.lit(3), F.lit(None).cast("string")), R.safe_file_name(F.lit("http://x/y.jpg?z=1"), F.lit("f")), R.safe_file_name(F.lit("http://x/"), F.lit("f")))
    assert tuple(r) == ("LeftMostWidthVsHeight", "LeftMost", None, "b.png", "image_000003.jpg", "y.jpg", "f")


def test_records_of_json(spark):
    df = spark.createDataFrame([('{"meta": 1, "samples": [{"captions": ["a", "b"], "image": "p.png"}]}',), ('[{"options": ["c"], "filepath": "q.png"}]',)], "value string")
    rows = S.json_records(df).select("pos", S.first_of(F.col("record"), S.CAPTION_KEYS, "array<string>").alias("c"), S.first_of(F.col("record"), S.IMAGE_KEYS, "string").alias("i")).collect()
    assert [tuple(r) for r in rows] == [(0, ["a", "b"], "p.png"), (0, ["c"], "q.png")]
    with pytest.raises(Exception, match="no list of records"):
        S.json_records(spark.createDataFrame([("{}",)], "value string")).collect()


def test_samples_of_captions_and_choices(spark):
    v = spark.createDataFrame([(0, "7", "a cat", 1, None, "cat", None, b"x"), (1, None, "b", 0, "on", None, None, b"x"), (2, None, "c", 1, None, None, None, None)], "row_index int, id string, caption string, label int, relation string, subj string, obj string, image binary")
    assert [(r.sample_id, r.gold_answer, r.relation, r.subject) for r in S.vsr_samples(v, "test").orderBy("caption").collect()] == [("7", "yes", "unknown", "cat"), ("test_1", "no", "on", "")]
    w = spark.createDataFrame([("s", k, None, f"d/cup_on_{k}.png", ["a cup left of a bowl", "a cup under a bowl", "a cup on a bowl"], None) for k in range(6)] + [("s", 9, "x", "d/one.png", ["only"], None)], "subset string, idx int, id string, image_path string, options array<string>, group_id string")
    rows = S.whatsup_samples(w).collect()
    assert len(rows) == 6 and all(r.options["ABC".index(r.gold_answer)] == r.gold_caption and r.gold_preposition == "left_of" for r in rows) and len({r.gold_answer for r in rows}) > 1 and rows[0].group_key.startswith("s:cup:")
    assert tuple(one(spark, S.options_of(F.lit('["a", "b"]')), S.options_of(F.lit("bad")), S.options_of(F.lit(None).cast("string")))) == (["a", "b"], [], [])
    r = one(spark, S.group_key(F.lit("s"), [F.lit(None).cast("string"), F.lit("g")], F.lit("d/a.png"), F.lit(5)), S.group_key(F.lit("s"), [], F.lit("d/a.png"), F.lit(5)), S.group_key(F.lit("s"), [], F.lit("a.png"), F.lit(5)))
    assert tuple(r) == ("s:g", "s:d:a", "s:idx_group:1")


def test_samples_of_letters_points_and_chats(spark):
    e = spark.createDataFrame([(0, None, "q?", " b) x", None, ["i"] * 5)], "row_index int, question_id string, question string, answer string, question_type string, images array<string>")
    r = S.erqa_samples(e).first()
    assert (r.sample_id, r.gold_answer, r.question_type, r.image_count, r.input_mode) == ("erqa_0", "B", "unknown", 5, "contact_sheet")
    p = spark.createDataFrame([(0, "q", " yes ", "context", b"m"), (1, "q", "no", None, None)], "row_index int, question string, answer string, category string, mask binary")
    assert [(r.answer_format, r.category, r.has_mask) for r in S.robospatial_samples(p, "dev").orderBy("sample_id").collect()] == [("points", "context", 1), ("yes_no", "dev", 0)]
    c = spark.createDataFrame([(k, json.dumps([{"role": "Human", "content": [{"type": "image"}, {"type": "text", "text": "How far?"}]}, {"role": "gpt", "text": "2 m"}, "junk"])) for k in range(20)] + [(99, "{bad")], "id bigint, m string")
    turns = S.chat_turns(c, "id", "m")
    assert {(r.role, r.text) for r in turns.collect()} == {("user", "How far?"), ("assistant", "2 m")}
    ex = S.openspaces_examples(turns, limits={"train": 5})
    assert {r.split: r["count"] for r in ex.groupBy("split").count().collect()} == {"train": 5, "evaluation": 2}
    assert {(r.metric, r.key): r.value for r in E.split_summary(ex).where("split = 'train'").collect()} == {("num_qa_pairs", ""): 5, ("num_source_rows", ""): 5, ("question_type_counts", "DistanceSpatial"): 5, ("answer_type_counts", "numeric"): 5}


def test_points_on_masks(spark):
    mask = bytes([255] * 50 + [0] * 50)
    df = spark.createDataFrame([(1, "[(0.5, 0.1), (0.5, 0.9)]", "(0.1, 0.0)", mask, 10, 10), (2, "(0.5, 0.9)", "(0.1, 0.95)", mask, 10, 10), (3, "(0.5, 0.9)", "", None, 10, 10), (4, "no", "", mask, 10, 10)], "id bigint, said string, gold string, mask binary, width int, height int")
    got = {r.id: (r.n_points, r.first_correct, r.any_correct, r.valid_fraction) for r in S.scored_points(df).collect()}
    assert got == {1: (2, 1, 1, 0.5), 2: (1, 1, 1, 1.0), 3: (1, 0, 0, 0.0), 4: (0, 0, 0, 0.0)}


def test_draws_and_zips(spark):
    rows = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 1)], "t string, k int")
    assert S.one_of_each(rows, ["t"], "k").count() == 2
    got = S.topped_up(rows.where("k < 3"), rows, "t", "k", 5).groupBy("t").agg(F.count("*").alias("n"), F.count_if("stored").alias("s")).collect()
    assert {(r.t, r.n, r.s) for r in got} == {("a", 5, 3), ("b", 1, 1)}
    assert [tuple(r) for r in S.zipped(rows.where("t = 'a'"), spark.range(2).toDF("z"), ["k"], ["z"]).orderBy("k").select("k", "z").collect()] == [(0, 0), (1, 1)]
    assert S.by_image(rows, "t", "k", ["k"]).count() == 10


METRIC_ROWS = [("yes", "on", "yes", 1), ("no", "on", "", 0), ("yes", None, "yes", 1), ("no", "under", "yes", 0)]


def long(df):
    return {(r.metric, r.key): r.value for r in df.collect()}


def test_benchmark_metrics(spark):
    v = spark.createDataFrame(METRIC_ROWS, "gold_answer string, relation string, parsed_prediction string, is_correct int")
    got = long(E.vsr_metrics(v))
    assert got["overall_accuracy", ""] == 0.5 and got["parse_failure_rate", ""] == 0.25 and got["relation_accuracy", "on"] == 0.5 and got["relation_macro_accuracy", ""] == 0.5 and got["relation_counts", "unknown"] == 1 and got["prediction_distribution", "yes"] == 3
    w = spark.createDataFrame([("s", p, q, "g", "A", int(p == q)) for p, q in (("left_of", "left_of"), ("right_of", "right_of"), ("on", "on"), ("under", "on"))], "subset string, gold_preposition string, predicted_preposition string, group_key string, parsed_prediction string, is_correct int")
    got = long(E.whatsup_metrics(w))
    assert got["pair_accuracy", ""] == 0.5 and got["pair_count", ""] == 2 and got["set_accuracy", ""] == 0 and got["confusion_matrix", "under/on"] == 1
    e = v.withColumn("question_type", F.lit("t")).withColumn("image_count", F.lit(3))
    assert long(E.erqa_metrics(e))["image_count_accuracy", "2-3"] == 0.5
    r = spark.createDataFrame([("c", "points", "g", "[]", "unparsed", 0, 0, 1, 0.5), ("b", "yes_no", "yes", "yes", "first_token", 1, None, None, None)], "category string, answer_format string, gold_answer string, parsed_prediction string, parse_method string, is_correct int, first_point_correct int, any_point_correct int, valid_point_fraction double")
    got = long(E.robospatial_metrics(r))
    assert got["binary_accuracy", ""] == 1 and got["context_any_point_accuracy", ""] == 1 and got["context_parse_failure_rate", ""] == 1 and got["binary_counts", "yes"] == 1
    assert long(E.robospatial_metrics(r.where("category = 'b'")))["context_any_point_accuracy", ""] is None


def test_reports(spark):
    m = spark.createDataFrame([(1, '{"a": 0.5, "b": {"c": 2, "d": true, "e": null, "f": "x", "g": {"h": 1}}}'), (2, "bad")], "id int, p string")
    assert {(r.path, r.value) for r in E.flat_metrics(m, "id", "p").collect()} == {("a", 0.5), ("b/c", 2.0), ("b/d", 1.0), ("b/g/h", 1.0)}
    t = spark.createDataFrame([("q", 0.001, 0.002, True, 2), ("q", 0.003, 0.004, True, 0), ("q", 0.002, 0.0, False, 0), ("z", 0.1, 0.0, False, 0)], "question_type string, is_applicable_sec double, apply_sec double, applicable boolean, n_qa int")
    r = {x.question_type: x for x in E.profile(t).collect()}
    assert abs(r["q"].is_applicable_ms - 2) < 1e-9 and abs(r["q"].apply_ms - 3) < 1e-9 and (r["q"].hit_rate, r["q"].empty, r["z"].hit_rate) == (50, 1, 0) and E.profile_table(t).count("\n") == 3
    s = spark.createDataFrame([("t", "q", "a"), ("t", "", "a"), ("u", "q", "Question not applicable"), ("u", "q", "b")], "question_type string, question string, answer string")
    assert {tuple(x) for x in E.stored_question_counts(s).collect()} == {("t", 1), ("u", 1), ("total", 2)}


def test_labels_and_summaries_of_trials(spark):
    f = spark.createDataFrame([("r", "t", 1, None, True, "arrived", "no"), ("r", "t", 2, None, True, "arrived", "hit the bench"), ("r", "t", 3, None, False, "timeout", ""), ("r", "t", 4, False, True, "x", "y")], "run_dir string, test_name string, trial int, human_success boolean, model_loop_success boolean, failure_reason string, notes string")
    fix = spark.createDataFrame([("r", "t", 4, True, "arrived")], "run_dir string, test_name string, trial int, new_human_success boolean, new_failure_reason string")
    got = {r.trial: (r.human_success, r.failure_reason) for r in E.final_labels(f, fix).collect()}
    assert got == {1: (True, "arrived"), 2: (False, "hit the bench"), 3: (False, "timeout"), 4: (True, "arrived")}
    t = spark.createDataFrame([("t", "base", False)] * 4 + [("t", "finetuned", True), ("t", "finetuned", False), ("u", "finetuned", True)], "test_name string, variant string, success boolean")
    r = {x.test_name: x for x in E.trial_summary(t).collect()}
    assert r["t"].delta_pct == 50 and r["u"].base_accuracy_pct is None
    assert E.reasons(E.final_labels(f)).count() == 4
    c = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9)], "run string, step int, seen_accuracy double")
    assert E.best_checkpoint(c).first().step == 2


def test_leak_guard(spark):
    good = spark.createDataFrame([("CountPeople", "train"), ("ClosestBenchWithPerson", "test"), (None, "train")], "question_type string, split string")
    assert E.guard_no_leak(good, F.col("split")).count() == 3
    with pytest.raises(Exception, match="held-out type in train"):
        E.guard_no_leak(good.union(spark.createDataFrame([("closest_bench_with_person", "train")], good.schema)), F.col("split")).collect()


def test_annotated_sources(spark, tmp_path):
    keys = ("seg", 1_532_402_520_000_000, 1)  # 2018-07-24 03:22 UTC
    late = ("seg", keys[1] + 6 * 3_600_000_000, 1)
    images = spark.createDataFrame([(*keys, b"x"), (*late, b"y"), (*late, b"y")], "segment string, timestamp_micros bigint, camera int, image binary")
    boxes = spark.createDataFrame([(*keys, 1, 10.0, 10.0, 4.0, 2.0), (*late, 2, 5.0, 5.0, 2.0, 2.0), (*late, 9, 5.0, 5.0, 2.0, 2.0)], "segment string, timestamp_micros bigint, camera int, type int, cx double, cy double, w double, h double")
    assert A.waymo(images, boxes).count() == 2
    r = A.waymo(images, boxes, by_day=True).first()
    assert [b.label for b in r.boxes] == ["person", "undefined"] and r.boxes[0].x1 == 4 and r.source_id.endswith("_1")
    samples = spark.createDataFrame([("s1", "n-2018-07-24-11-22-33.jpg"), ("s2", "n-2018-07-24-19-22-33.jpg"), ("s3", "x")], "token string, file_name string")
    ann = spark.createDataFrame([("s1", "c1", ["a1", "a2"], [1, 2, 3, 4]), ("s2", "c1", [], [1, 2, 3, 4])], "sample_token string, category_token string, attribute_tokens array<string>, bbox array<int>")
    cats, attrs = spark.createDataFrame([("c1", "vehicle.car")], "token string, name string"), spark.createDataFrame([("a1", "moving"), ("a2", "big")], "token string, name string")
    got = {r.sample_token: r.objects for r in A.nuimages(samples, ann, cats, attrs).collect()}
    assert set(got) == {"s1", "s2"} and got["s1"][0].attributes == ["big", "moving"] and [r.sample_token for r in A.nuimages(samples, ann, cats, by_day=True).collect()] == ["s1"]
    r = one(spark, A.mapped_category(F.lit("rider"), "bdd"), A.mapped_category(F.lit("rider"), "bdd", original=False), A.mapped_category(F.lit("blob"), "bdd", original=False), A.rle_area(F.array(*map(F.lit, (2, 3, 1, 4)))))
    assert [tuple(x) for x in r[:3]] == [("rider", 0), ("person", 0), ("blob", -1)] and r[3] == 7
    assert A.by_token(samples, "token", "s3").count() == 1


def test_folders_splits_and_settings(spark, tmp_path):
    for name in ("b.PNG", "sub/a.JpEg", "note.txt"):
        p = tmp_path / "img" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    assert [(r.position, r["name"]) for r in A.sorted_images(spark, str(tmp_path / "img")).orderBy("position").collect()] == [(0, "b.PNG"), (1, "sub/a.JpEg")]
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        A.sorted_images(spark, str(tmp_path / "none"))
    assert A.parse_splits("train+val,train") == ["train", "val"] and A.file_split("waymo", "val") == "validation" and A.file_split("waymo", "train") == "training"
    with pytest.raises(ValueError):
        A.parse_splits("train+odd")
    (tmp_path / "c.json").write_text(json.dumps({"dataset_name": "d", "batch_size": 4, "odd": 1, "allowable_set": ["person"]}))
    c = A.config_from_file(str(tmp_path / "c.json"), split="val", num_samples=None)
    assert (c.batch_size, c.split, c.confidence_threshold) == (4, "val", 0.2)
    for bad in ({}, {"dataset_name": "d", "confidence_threshold": 2}, {"dataset_name": "d", "allowable_set": ["undefined"]}, {"dataset_name": "d", "use_wbf": True}):
        with pytest.raises(ValueError):
            A.config_of(bad)
    rows = spark.createDataFrame([((b"x", "p"), "q", 3, "t", "s", 1, datetime(2025, 1, 1))], "image struct<bytes:binary,path:string>, question string, answer int, question_type string, source_id string, id int, t timestamp")
    rows.write.parquet(str(tmp_path / "qa" / "train-0.parquet"))
    assert A.qa_split(spark, str(tmp_path / "qa"), "train").first().answer == "3"
