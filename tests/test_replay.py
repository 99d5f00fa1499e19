"""Replayed logs, exports and precision on small cases."""

import json
import random
import tarfile
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import exports as X
from quillon.streaming import replay as R

LOG = "run_id string, seq int, phase string, question_type string, answer string"


def log(spark, *runs):
    return spark.createDataFrame([(name, k, p, q, a) for name, rows in runs for k, (p, q, a) in enumerate(rows)], LOG)


def test_attempts_end_at_the_first_valid_one(spark):
    rows = [("r", 1, 1, "q", "x"), ("r", 1, 2, "q", "3"), ("r", 1, 3, "q", "4"), ("r", 2, 1, "q", "x"), ("r", 2, 2, "q", "y"), ("r", 2, 3, "q", None), ("r", 2, 4, "q", "5")]
    df = spark.createDataFrame(rows, "run_id string, step int, attempt int, question_type string, answer string")
    got = {r.step: (r.tries, r.value, r.ok) for r in R.attempts(df, F.col("answer").rlike("^[0-9]$"), retries=2).collect()}
    assert got == {1: (2, "3", True), 2: (3, None, False)}


def test_stretches_of_phases(spark):
    got = [tuple(r)[2:] for r in R.stretches(log(spark, ("r", [("a", "", ""), ("a", "", ""), ("b", "", ""), ("a", "", "")]))).orderBy("stretch").collect()]
    assert got == [("a", 0, 1, 2), ("b", 2, 2, 1), ("a", 3, 3, 1)]


def test_facing_and_arriving(spark):
    t, a = "TurnDirectionToBench", "ArrivedAtBench"
    runs = {
        "ok": [("", t, "turn left"), ("", t, "already facing"), ("", a, "No"), ("", a, "yes")],
        "lost": [("", t, "turn left"), ("", t, "???"), ("", t, "already facing"), ("", a, "yes")],
        "short": [("", t, "already facing"), ("", a, "no"), ("", a, "hm"), ("", a, "yes")],
        "long": [("", t, "turn left")] * 4 + [("", t, "already facing")],
    }
    got = {r.run_id: r.reason for r in R.face_and_arrive(log(spark, *runs.items()), max_turns=4).collect()}
    assert got == {"ok": "arrived", "lost": "failed_to_face_target", "short": "failed_to_arrive", "long": "failed_to_face_target"}


def test_loops_and_targets(spark):
    df = spark.createDataFrame([("a", 1, "no", "left"), ("a", 2, "yes", None), ("b", 1, "no", None), ("b", 2, "yes", "left"), ("c", 1, "no", "left"), ("c", 2, None, "left")], "run_id string, step int, arrived string, side string")
    got = {r.run_id: (r.reason, r.steps) for r in R.until_arrived(df, F.col("side").isNotNull()).collect()}
    assert got == {"a": ("arrived", 2), "b": ("parse_failure_or_no_action", 1), "c": ("timeout", 2)}
    r = spark.range(1).select(R.target_of("conditioned_list", F.lit("0, 3")), R.target_of("ordered_visit", F.lit("none")), R.target_of("closest_navigation", F.lit("0")), R.target_of("pairwise_then_visit", F.lit("2"), F.array(F.lit(1), F.lit(2))), R.target_of("pairwise_then_visit", F.lit("x"), F.array(F.lit(1), F.lit(2)))).first()
    assert [tuple(x) for x in r] == [(3, None), (None, "empty_ordered_list"), (None, "no_valid_target"), (2, None), (None, "invalid_pairwise_choice")]
    v = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)], "run_id string, place int, arrived boolean")
    assert {tuple(r) for r in R.ordered_visits(v).collect()} == {("a", 1, "ordered_visit_failed"), ("b", 1, "ordered_visit_complete")}
    f = spark.createDataFrame([("egocentric", "timeout"), ("egocentric", "odd"), ("none", "timeout")], "protocol string, reason string")
    assert {(r.protocol, r.reason): r.known for r in R.reasons_by_protocol(f).collect()} == {("egocentric", "timeout"): True, ("egocentric", "odd"): False, ("none", "timeout"): False}


def test_missions_movements_and_caches(spark):
    m = {"done": [("people", 2), ("pickup", 1), ("people", 0), ("stops", 2), ("stop", 1), ("stop", 2)], "lost": [("people", 1), ("pickup", -1)], "mute": [("people", None)], "half": [("people", 0), ("stops", 2), ("stop", 1)], "none": [("people", 0), ("stops", 0)]}
    df = spark.createDataFrame([(r, k, e, t) for r, rows in m.items() for k, (e, t) in enumerate(rows)], "run_id string, seq int, event string, target int")
    got = {r.run_id: (r.pickups, r.stops, r.reason) for r in R.missions(df).collect()}
    assert got == {"done": (1, 2, "task_complete"), "lost": (0, 0, "failed_to_reach_pickup_bench"), "mute": (0, 0, "count_people_parse_failure"), "half": (0, 1, "task_failed"), "none": (0, 0, "no_animal_stops_found")}
    t0 = datetime(2025, 1, 1)
    p = spark.createDataFrame([("r", t0, 0.0, 0.0), ("r", t0 + timedelta(seconds=2), 3.0, 4.0), ("r", t0 + timedelta(seconds=2), 3.0, 4.0)], "run_id string, ts timestamp, x double, y double")
    rows = R.movements(p).orderBy("distance").collect()
    assert rows[0].speed is None and rows[2].distance == 5 and rows[2].speed == 2.5 and abs(rows[2].heading - 53.130102) < 1e-5
    work, cache = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, k string"), spark.createDataFrame([("b", "x")], "k string, answer string")
    known, todo = R.cached(work, cache, ["k"])
    assert known.where("answer = 'x'").count() == 1 and [r.k for r in todo.collect()] == ["a"]


def test_archives_roll_over(spark, tmp_path):
    rng = random.Random(3)
    for sizes in ([rng.randint(0, 90) for _ in range(400)], [200] * 5, [], [0, 0, 100, 0, 1, 100, 0]):
        df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k int, size int")
        got = [r.shard for r in X.rolled(df, "k", "size", 100).orderBy("k").collect()]
        want, begin, shard = [], 0, 0
        for s in sizes:
            want.append(shard)
            begin += s
            if begin > 100:
                begin, shard = 0, shard + 1
        assert got == want
    rows = spark.createDataFrame([(0, "a.txt", b"one"), (0, "b.txt", b""), (1, "c.txt", b"three")], "shard bigint, name string, content binary")
    X.write_archives(rows, str(tmp_path), "name", "content")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["shard-000000.tar", "shard-000001.tar"]
    with tarfile.open(tmp_path / "shard-000001.tar") as tar:
        assert tar.extractfile("c.txt").read() == b"three"


def test_tables_and_json(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert X.write_csv([a, b], str(tmp_path / "t")) == ["a", "b", "c"] and X.write_csv([], str(tmp_path / "n")) == []
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["a", "b", "c"]
    X.log_rows(a, str(tmp_path / "log")), X.log_rows(b, str(tmp_path / "log"))
    logged = spark.read.json(str(tmp_path / "log"))
    assert set(logged.columns) == {"a", "b", "c", "timestamp"} and logged.where("timestamp is null").count() == 0
    j = spark.createDataFrame([('{"a": [{"output_dir": 1, "b": 2}], "adapter_path": "x"}',), ("no json",), (None,)], "j string")
    assert [r.j for r in X.cleaned_json(j, "j").collect()] == ['{"a": [{"b": 2}]}', "no json", None]
    X.write_json({"ä": 1}, str(tmp_path / "d" / "r.json"))
    assert json.loads((tmp_path / "d" / "r.json").read_text()) == {"ä": 1}
    k = spark.createDataFrame([("t", "1.pkl", 2, "q2", "a2", "train", 7), ("t", "1.pkl", 1, "q1", "a1", "train", 7)], "question_type string, k string, id int, question string, answer string, split string, n_labels int")
    assert json.loads(X.key_value_store(k, "k").first().value) == {"qa_list": [["q1", "a1"], ["q2", "a2"]], "split": "train", "num of labels": 7}
    assert X.finished(spark.createDataFrame([("t", 1.0), ("t", 0.0), ("u", 1.0)], "table string, score double"), "table", 2).count() == 1


BOX = "image_id bigint, label string, det_idx int, cls int, score double, x1 double, y1 double, x2 double, y2 double, img_w int, img_h int"


def test_detections_as_relations(spark):
    t = spark.createDataFrame([(7, "a", 0, 3, 1.0, 1.0, 2.0, 4.0, 6.0, 9, 8), (7, "a", 1, 3, 1.0, 0.0, 0.0, 1.0, 1.0, 9, 8), (9, "a", 0, 1, 1.0, 0.0, 0.0, 1.0, 1.0, 9, 8)], BOX)
    images, ann, found = X.coco(t, t.withColumn("score", F.col("det_idx") + 0.1), 0.5)
    assert [tuple(r) for r in images.orderBy("id").collect()] == [(1, 7, 9, 8), (2, 9, 9, 8)] and [r.id for r in ann.orderBy("id").collect()] == [1, 2, 3] and ann.orderBy("id").first().bbox == [1, 2, 3, 4] and found.count() == 1


def test_average_precision_against_a_loop(spark):
    rng = np.random.default_rng(1)
    truth, found = [], []
    for i in range(30):
        for k in range(rng.integers(0, 4)):
            x, y = map(float, rng.uniform(0, 80, 2))
            truth.append((i, "ab"[k % 2], k, 0, 1.0, x, y, x + 20, y + 20, 100, 100))
            if rng.random() < 0.7:
                dx = float(rng.normal(0, 4))
                found.append((i, "ab"[k % 2], 10 + k, 0, float(rng.random()), x + dx, y, x + 20 + dx, y + 20, 100, 100))
        if rng.random() < 0.5:
            found.append((i, "ab"[i % 2], 90, 0, float(rng.random()), 0.0, 0.0, 5.0, 5.0, 100, 100))
    got = {r.label: r.ap for r in X.average_precision(spark.createDataFrame(truth, BOX), spark.createDataFrame(found, BOX)).collect()}

    def iou(a, b):
        w, h = max(0, min(a[7], b[7]) - max(a[5], b[5])), max(0, min(a[8], b[8]) - max(a[6], b[6]))
        return w * h / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - w * h)

    for label in "ab":
        t, used, hits = [x for x in truth if x[1] == label], set(), []
        for f in sorted((x for x in found if x[1] == label), key=lambda x: -x[4]):
            best = max((k for k, x in enumerate(t) if x[0] == f[0] and k not in used), key=lambda k: iou(f, t[k]), default=None)
            hits.append(best is not None and iou(f, t[best]) >= 0.5)
            if hits[-1]:
                used.add(best)
        tp = np.cumsum(hits)
        recall, precision = tp / len(t), tp / np.arange(1, len(hits) + 1)
        want = np.mean([precision[recall >= r - 1e-9].max(initial=0) for r in np.arange(101) / 100])
        assert abs(got[label] - want) < 1e-9
    m = {r.iou: r["map"] for r in X.mean_average_precision(spark.createDataFrame(truth, BOX), spark.createDataFrame(truth, BOX), (0.5, 0.9)).collect()}
    assert m == {0.5: 1.0, 0.9: 1.0}


def test_measures_of_images_and_gathered_models(spark):
    from quillon.operators import ensemble

    t = spark.createDataFrame([(1, "a", 0, 0, 1.0, 0.0, 0.0, 10.0, 10.0, 99, 99), (1, "a", 1, 0, 1.0, 50.0, 50.0, 60.0, 60.0, 99, 99), (2, "a", 0, 0, 1.0, 0.0, 0.0, 10.0, 10.0, 99, 99)], BOX)
    f = spark.createDataFrame([(1, "a", 0, 0, 0.9, 0.0, 0.0, 10.0, 9.0, 99, 99), (1, "a", 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0, 99, 99), (3, "a", 0, 0, 0.5, 0.0, 0.0, 5.0, 5.0, 99, 99)], BOX)
    assert {tuple(r) for r in X.image_measures(t, f).collect()} == {(1, 1, 1, 1), (2, 0, 0, 1), (3, 0, 1, 0)}
    both = ensemble.gathered({"m": t, "n": f, "none": f.limit(0)})
    assert {(r.model, r["count"]) for r in both.groupBy("model").count().collect()} == {("m", 3), ("n", 3)}
    fused = ensemble.weighted_fusion(both, {"m": 2.0, "n": 1.0, "none": 1.0}).where("image_id = 1").orderBy("x1").collect()
    assert [r.members for r in fused] == [3, 1] and fused[0].x2 == 10


def test_first_rows(spark):
    from quillon.operators.generate import first_rows

    assert [r.id for r in first_rows(spark.range(9).repartition(3), ["id"], 2).collect()] == [0, 1]
