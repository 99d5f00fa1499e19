"""Small cases of every operator: what it finds, and nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import frequency, languages, leaks, mixture, overlaps, rebalance, refusals, replies, splits, subjects
from quillon.llm.components import components, components_of_records

T0 = datetime(2025, 1, 1)
# Extra columns are named as the operators name their own.
QA = "id bigint, snapshot_id string, split string, source_id string, question_type string, question string, answer string, image struct<bytes:binary,path:string>, ingested_at timestamp, rank int, n int, kind string"


def qa(spark, rows):
    out = []
    for k, r in enumerate(rows):
        r = {"id": k + 1, "snapshot_id": "s", "split": "train", "source_id": "zoo_bus_1.png", "question_type": "CountPeople", "question": "How many people?", "answer": "1", "bytes": None, "late": 0} | r
        out.append((r["id"], r["snapshot_id"], r["split"], r["source_id"], r["question_type"], r["question"], r["answer"], (r["bytes"], "p"), T0 + timedelta(hours=r["late"]), 1, 2, "x"))
    return spark.createDataFrame(out, QA)


# Components and splits.


def test_components_are_those_of_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(0, k) for k in range(200, 260)] + [(k, k + 1) for k in range(300, 330)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges] + [(None, "1"), ("7", None)], "src string, dst string")
    got = {r.node: r.component for r in components(df).collect()}
    assert set(got) == {str(x) for x in parent}
    assert len(set(got.values())) == len({root(x) for x in parent})
    assert all(got[str(a)] == got[str(b)] for a, b in edges)


def test_components_of_nothing_and_of_records(spark):
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0
    df = spark.createDataFrame([("a1", "s1"), ("a1", "s2"), ("a2", "s2"), ("a3", "s9")], "author string, source string")
    got = {r.node: r.component for r in components_of_records(df, "id", ["author", "source"]).collect()}
    assert got["s1"] == got["a2"] and got["a3"] != got["a1"]


def test_sources_in_several_splits(spark):
    rows = [{"source_id": "zoo_bus_00000012.png"}, {"source_id": " export\\3\\ZOO-BUS-00000012_v3.PNG", "split": "Test"}, {"source_id": "zoo_bus_12.jpg", "split": None}, {"source_id": "park_bus_00000012.png", "split": "eval"}, {"source_id": "img_5f0a1b2c3d_copy.png", "split": "test"}, {"source_id": "scenes/b1/img_5f0a1b2c3d.jpg", "split": "validation"}, {"source_id": None, "split": "test"}, {"source_id": " "}, {"source_id": " ", "split": "val"}, {"source_id": "x" * 5000}]
    got = {r.source_id for r in splits.leaking_sources(qa(spark, rows)).collect()}
    assert got == {"zoo_bus_00000012.png", " export\\3\\ZOO-BUS-00000012_v3.PNG", "zoo_bus_12.jpg", "img_5f0a1b2c3d_copy.png", "scenes/b1/img_5f0a1b2c3d.jpg", " "}
    assert splits.leaking_sources(qa(spark, rows).limit(0)).count() == 0


def test_assigned_splits_keep_scenes_whole_and_near_their_shares(spark):
    rows = [{"source_id": f"zoo_bus_{k % 400:08d}.png"} for k in range(1200)] + [{"source_id": "zoo_bus_99999.png"} for _ in range(400)] + [{"source_id": None}, {"id": 1, "late": 5}, {"id": None}]
    targets = spark.createDataFrame([("train", 0.8), ("evaluation", 0.1), ("test", 0.1), (None, 0.5)], "split_name string, target_share double")
    out = splits.assign_splits(qa(spark, rows), targets).toPandas()
    assert len(out) == out.id.nunique() == 1601
    assert out.groupby("component").split.nunique().max() == 1
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    assert splits.assign_splits(qa(spark, rows).limit(0), targets).count() == 0


def test_splits_are_near_their_targets_for_each_type(spark):
    # Types that few scenes have, a hot scene and a scene of one type only.
    rows = [{"source_id": f"zoo_bus_{k % 300:08d}.png", "question_type": "abcdef"[(k % 300) % 6]} for k in range(3000)] + [{"source_id": "zoo_bus_99999.png", "question_type": "abcdef"[k % 6]} for k in range(600)] + [{"source_id": None, "question_type": None}] * 100
    targets = spark.createDataFrame([("train", 0.8), ("evaluation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = splits.assign_splits(qa(spark, rows), targets)
    rep = {(r.question_type, r.split): r.share for r in splits.split_report(got).collect()}
    assert all(abs(rep.get((t, s), 0) - w) <= 0.03 for t in [*"abcdef", "", "*"] for s, w in (("train", 0.8), ("evaluation", 0.1), ("test", 0.1)))
    assert got.groupBy("component").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] == 1


# Rebalancing.


def test_flow_is_the_cheapest():
    net = rebalance.Network(4)
    a, b = net.arc(0, 1, 5, 1), net.arc(0, 2, 5, 2)
    net.arc(1, 3, 3, 0), net.arc(2, 3, 9, 0)
    assert net.push(0, 3, 7) == 7 and (net.used(a), net.used(b)) == (3, 4)


def test_slack_tells_rows_from_room_and_floors_from_targets():
    def plan(*rows):
        cells = pd.DataFrame(rows, columns=["question_type", "split", "n", "target_share", "min_rows", "sample_rows"])
        return {r[0]: r[4:] for r in rebalance.plan_snapshot(cells) if r[2] == "type"}

    got = plan(("a", "t", 30, 0.5, 10, 10), ("b", "t", 30, 0.5, 10, 10))  # floors that don't fit into the sample
    assert sum(r[1] for r in got.values()) == 10 and sum(r[3] for r in got.values()) == 10 == sum(r[4] for r in got.values()) and not any(r[2] for r in got.values())
    got = plan(("a", "t", 3, 0.5, 5, 10), ("b", "t", 30, 0.5, 0, 10))
    assert got == {"a": (5, 3, 2, 0, 2), "b": (5, 7, 0, 0, 0)}
    rng = random.Random(2)
    for _ in range(20):
        size, rows = rng.randint(50, 900), []
        for i in range(29):
            share, floor = rng.random() / 15, rng.choice([0, 0, 5, 20])
            rows += [(f"q{i}", s, rng.choice([0, 3, 20, 80]), share, floor, size) for s in ("train", "evaluation", "test")]
        cells = pd.DataFrame(rows, columns=["question_type", "split", "n", "target_share", "min_rows", "sample_rows"])
        out = rebalance.plan_snapshot(cells)
        types, parts = [r for r in out if r[2] == "type"], [r for r in out if r[2] == "cell"]
        assert all(r[6] == max(0, r[4] - r[3]) for r in types) and sum(r[5] for r in types) == min(size, sum(r[3] for r in types))
        assert all(r[5] == sum(p[5] for p in parts if p[0] == r[0]) for r in types) and all(0 <= p[5] <= p[3] for p in parts)


def test_drawn_integers_are_next_to_their_amounts():
    for start in (0.0, 0.3, 0.99):
        got = rebalance.draw_integers([0.5, 1.5, 2.25, 0.75], 10, start)
        assert sum(got) == 10 and all(abs(g - 2 * x) < 1 for g, x in zip(got, [0.5, 1.5, 2.25, 0.75]))
    assert rebalance.draw_integers([0.0], 3, 0.1) == [0]


def test_sample_meets_targets_and_reports_what_is_missing(spark):
    rows = [{"question_type": t} for t, n in (("CountPeople", 60), ("count-animals", 30), ("ClosestBench", 3)) for _ in range(n)] + [{"question_type": None}, {"id": 1, "late": 3, "question_type": "CountPeople"}]
    target = [("s", "CountPeople", 0.5, 0, 40), ("s", "CountAnimals", 0.4, 20, 40), ("s", "ClosestBench", 0.1, 5, 40), ("t", "CountPeople", 1.0, 1, 10), (None, "x", 1.0, 1, 1), ("s", None, 1.0, 1, 1)]
    targets = spark.createDataFrame(target, "snapshot_id string, question_type string, target_share double, min_rows bigint, sample_rows bigint")
    assert {tuple(r) for r in rebalance.shortfalls(qa(spark, rows), targets).collect()} == {("s", "ClosestBench"), ("t", "CountPeople")}
    got = rebalance.sample(qa(spark, rows), targets).toPandas()
    assert len(got) == got.id.nunique() == 40
    n = got.question_type.value_counts()
    assert n["ClosestBench"] == 3 and n["CountAnimals"] >= 20
    assert rebalance.shortfalls(qa(spark, rows), targets.limit(0)).count() == 0
    assert rebalance.sample(qa(spark, rows).limit(0), targets).count() == 0


# Replies.

Q = "In which compass direction does bench 2 lie as seen from the bus?"


@pytest.mark.parametrize(
    "question, reply, want",
    [
        (Q, None, "empty_answer"), (Q, " ​\n", "empty_answer"), (Q, "answer: ", "empty_answer"), (Q, "``` ```", "empty_answer"), (Q, '{"answer": null}', "empty_answer"), (Q, "N/A", "empty_answer"),
        (Q, "Q: " + Q.upper(), "copies_question"), (Q, Q + " " + Q, "copies_question"), (Q, Q + " -> west", None), (Q, Q + " My answer: 2", None),
        (Q, "I'm sorry, but I cannot determine this from what was given.", "refusal"), (Q, "Sorry, I misread it at first; the right reply is west.", None), (None, "No comment.", "refusal"),
        ("¿Hacia qué punto cardinal mira el autobús?", "No puedo ver la imagen.", "refusal"),
        (Q, "Il se trouve à gauche.", "other_language"), (Q, "東北方向", "other_language"), (Q, "2", None), ("¿Cuántas personas se ven en esta escena?", "The number is three", "other_language"), ("¿Cuántas personas se ven?", "7", None),
        (Q, '{"answer": "west', "truncated_answer"), (Q, "1, 3,", "truncated_answer"), (Q, "It lies to the left of the", "truncated_answer"),
        (Q, "noth", None), (Q, "west [dunwick]", None), (Q, "No", None), (Q, "x " * 20_000, None),
    ],
)
def test_defect_of_a_reply(question, reply, want):
    assert replies.defect(question, reply, False) == want


def test_replies_of_other_make():
    assert replies.defect("Explain gravity in simple words please.", "Die Schwerkraft zieht Gegenstände zueinander hin.", False) == "other_language"
    assert replies.defect("Explain gravity in simple words please.", "this request goes against policy so I will pass on it", False) == "refusal"
    assert replies.defect("What is the capital of Norway?", "I will not be able to help you with that one", False) == "refusal"
    for fine in ("I would not recommend turning left", "The bus must pass on the left", "West, see code ma-223", "Oslo (tu-790)"):
        assert replies.defect("Where should the bus go next, and why?", fine, False) is None
    for text, lang in (("Explica la gravedad con palabras sencillas", "es"), ("Expliquez simplement la gravité", "fr"), ("Erkläre bitte die Schwerkraft einfach", "de"), ("Painted wall", None), ("東北方向", "CJK")):
        assert languages.language(languages.words_of(text)) == lang


def test_replies_cut_inside_a_word(spark):
    texts = ["plants convert light energy into chemical energy.", "the chemical reaction is slow", "a chemical is used", "energy of chemicals", "plants convert light energy into chem", "light energy into energy", "zqx light energy into zqxw", "chem"]
    p = spark.createDataFrame([(k, "How do plants work?", t, "They grow.", T0) for k, t in enumerate(texts)] + [(90, None, None, "", T0)], "pred_id bigint, question string, raw_prediction string, gold_answer string, scored_at timestamp")
    got = {r.pred_id for r in replies.broken_replies(p).where("defect = 'truncated_answer'").collect()}
    assert got == {4}


def test_covered_runs_of_words():
    auto = replies.SuffixAutomaton("a b c d e b c x".split())
    assert auto.longest("z b c d q c x".split()) == [0, 1, 2, 3, 0, 1, 2]
    assert replies.covered([0, 1, 2, 3, 0, 1, 2], 3) == [False, True, True, True, False, False, False]
    assert refusals.PhraseAutomaton([["a", "b"], ["b", "c", "d"]]).finds("x a c b c d".split())


def test_replies_that_others_go_on_from(spark):
    texts = ["turn right"] * 40 + ["turn ri", "northeast"] * 2 + ["north"] * 2 + ["There are 3 of them in"] + [f"There are {k} of them in the picture." for k in range(9)]
    rows = [(k, Q, t, "west", T0, 1, "y") for k, t in enumerate(texts)] + [(0, Q, "turn right", "west", T0 + timedelta(1), 1, "y"), (None, Q, "turn ri", None, T0, 1, "y"), (999, None, None, "", None, None, None)]
    p = spark.createDataFrame(rows, "pred_id bigint, question string, raw_prediction string, gold_answer string, scored_at timestamp, n int, form string")
    got = {(r.pred_id, r.field): r.defect for r in replies.broken_replies(p).collect()}
    want = {(k, "raw_prediction"): "truncated_answer" for k, t in enumerate(texts) if t in ("turn ri", "There are 3 of them in")}
    assert got == want | {(999, "raw_prediction"): "empty_answer", (999, "gold_answer"): "empty_answer"}
    assert replies.broken_replies(p.limit(0)).count() == 0


def test_long_and_single_replies_that_others_go_on_from(spark):
    whole = " ".join(f"stone{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)) + "."
    texts = [whole] * 8 + [whole[:2300], "The kiosk stands beside"] + [f"The kiosk stands beside {w}." for w in "Ostwick Dunhurst Randbury Verwick Brimvale".split()]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.form for r in replies.early_endings(df).collect()} == {whole[:2300], "The kiosk stands beside"}


# Frequencies.


def test_terms_of_both_fields(spark):
    p = spark.createDataFrame([(1, "Yes, 2 Ärger", T0, 1), (1, "Yes, 2 Ärger", T0, 1), (2, "yes yes", T0, 1), (3, None, T0, 1), (4, "", T0, 1), (None, "yes " * 5000, T0, 1)], "pred_id bigint, gold_answer string, scored_at timestamp, records int")
    s = spark.createDataFrame([("s", "t", T0, [(" Turn\t left ", 3), ("x", 1), (None, 2)], 1), ("s", "t", T0, [(" Turn\t left ", 3), ("x", 1), (None, 2)], 1), ("s", "u", T0, None, 1)], "snapshot_id string, question_type string, computed_at timestamp, top_answers array<struct<answer:string,n:bigint>>, term int")
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in frequency.frequency_report(p, s).collect()}
    assert got == {("gold_answer", "yes"): (5003, 3, "too_common"), ("gold_answer", "2"): (1, 1, "too_rare"), ("gold_answer", "ärger"): (1, 1, "too_rare"), ("top_answers", "turn left"): (1, 1, "too_rare"), ("top_answers", "x"): (1, 1, "too_rare")}
    assert frequency.marked_terms(p.limit(0), s.limit(0)).count() == 0


# Overlaps.


def picture(seed, noise=0, moved=False):
    cells = np.random.default_rng(seed).integers(20, 230, (5, 5)).repeat(2, 0).repeat(2, 1)
    cells = cells + np.random.default_rng(seed + 10_000).integers(-6, 7, (10, 10))
    if moved:
        cells[:4, :4] = 250 - cells[:4, :4]
    if noise:
        cells = cells + np.random.default_rng(noise).integers(-4, 5, (10, 10)) + 3
    return b"P5\n10 10\n255\n" + np.clip(cells, 0, 255).astype(np.uint8).tobytes()


def test_same_pictures_and_questions_across_splits(spark):
    ask = "How many people are waiting at bench 2?"
    rows = [
        {"id": 1, "question": ask, "bytes": picture(1)}, {"id": 2, "question": "Q: how many  persons are queueing at bench 2", "bytes": picture(1, noise=5), "split": "test"},
        {"id": 3, "question": ask, "bytes": picture(1, moved=True), "split": "test"}, {"id": 4, "question": ask.replace("2", "3"), "bytes": picture(1), "split": "eval"},
        {"id": 5, "question": ask, "bytes": picture(1), "split": "val"}, {"id": 6, "question": ask, "bytes": picture(1), "split": None}, {"id": 7, "question": None, "bytes": picture(1), "split": "test"},
        {"id": 8, "question": ask, "bytes": None, "split": "test"}, {"id": 9, "question": ask, "bytes": b"GIF89a", "split": "test"}, {"id": 10, "question": ask, "bytes": b"GIF89a"}, {"id": 1, "question": ask, "bytes": picture(1), "late": 1},
        {"id": 11, "question": ask, "bytes": b"P5\n0 0\n255\n", "split": "test"}, {"id": 12, "question": ask.replace("bench", "stop sign").replace("people", "animals"), "bytes": picture(1), "split": "test"},
    ]
    rows[-1]["question_type"] = "CountAnimalsAtStopSign"
    got = sorted((r.id_a, r.id_b) for r in overlaps.overlapping_rows(qa(spark, rows)).collect())
    assert got == [(1, 2), (1, 5), (9, 10)]
    assert overlaps.overlapping_rows(qa(spark, rows).limit(0)).count() == 0


def test_question_kinds_by_type_or_by_the_usual_type_of_the_wording(spark):
    pic = picture(3)
    rows = [
        {"id": 1, "question": "How many people at bench 2?", "bytes": pic, "question_type": "CountPeopleAtBench"},
        {"id": 2, "question": "Count the persons near bench 2, please", "bytes": pic, "question_type": "count_people_at_bench", "split": "test"},
        {"id": 3, "question": "How many people at bench 2?", "bytes": pic, "question_type": None, "split": "test"},
        {"id": 4, "question": "How many people at bench 3?", "bytes": pic, "question_type": None, "split": "test"},
        {"id": 5, "question": "Unheard of 2", "bytes": pic, "question_type": None, "split": "test"}, {"id": 6, "question": "unheard OF 2", "bytes": pic, "question_type": None},
        {"id": 7, "question": "?!", "bytes": pic, "split": "test"}, {"id": 8, "question": "How many people at bench 2?", "bytes": pic, "question_type": "ClosestBench", "split": "test"},
    ]
    got = sorted((r.id_a, r.id_b) for r in overlaps.overlapping_rows(qa(spark, rows)).collect())
    assert got == [(1, 2), (1, 3), (5, 6)]
    assert [(r.split, r.pairs) for r in overlaps.overlap_report(qa(spark, rows)).collect()] == [("test", 3)]


def test_pictures_of_png():
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"

    values = np.random.default_rng(0).integers(0, 256, (6, 5, 3))
    lines, before = b"", np.zeros(15, int)
    for y, row in enumerate(values.reshape(6, 15)):
        kind, line = y % 5, []
        for x in range(15):
            a, b, c = (row[x - 3] if x > 2 else 0), before[x], (before[x - 3] if x > 2 else 0)
            guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(a + b - c - v)))[kind]
            line.append((row[x] - guess) % 256)
        lines, before = lines + bytes([kind, *line]), row
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    w, h, got = overlaps.pixels(data)
    assert (w, h) == (5, 6) and np.allclose(got.reshape(6, 5), values.mean(axis=2))
    assert overlaps.pixels(data[:-30]) is None and overlaps.pixels(b"\xff\xd8jpeg") is None


def test_common_digests_are_left_to_fine_ones(spark):
    rng = np.random.default_rng(7)
    flat = lambda grey, noise: b"P5\n10 10\n255\n" + np.clip(grey + rng.integers(-noise, noise + 1, (10, 10)), 0, 255).astype(np.uint8).tobytes()
    pics = [(k, picture(k), True, False) for k in range(20)] + [(100 + k, picture(k, noise=50 + k), False, True) for k in range(20)] + [(200 + k, flat(90, 40), True, False) for k in range(40)] + [(300 + k, flat(90, 40), False, True) for k in range(40)] + [(400, flat(10, 1), True, False), (401, flat(200, 1), False, True)]
    df = spark.createDataFrame([(str(k).encode(), b, t, o) for k, b, t, o in pics], "pic binary, bytes binary, in_train boolean, in_other boolean")
    for common in (overlaps.COMMON, 0):
        got = {(int(r.pic_a), int(r.pic_b)) for r in overlaps.picture_links(df, common=common).collect()}
        assert got == {(k, 100 + k) for k in range(20)}


def test_pictures_of_common_digests_lose_no_pair(spark):
    # Cells of this pair differ by 13: they share coarse steps of 24, but no fine step of 12.
    side = np.where(np.random.default_rng(3).random((5, 5)) < 0.5, 12.0, -12.0)
    turn = np.where(np.indices((5, 5)).sum(0) % 2, 6.5, -6.5)
    drawn = lambda cells: b"P5\n10 10\n255\n" + np.round(128 + cells.repeat(2, 0).repeat(2, 1)).astype(np.uint8).tobytes()
    pics = [(1, drawn(side + turn), True, False), (2, drawn(side - turn), False, True), (3, drawn(side - turn * 2), False, True)]
    pics += [(10 + k, picture(k % 9, noise=50 + k), k % 2 == 0, k % 3 > 0) for k in range(60)]
    df = spark.createDataFrame([(str(k).encode(), b, t, o) for k, b, t, o in pics], "pic binary, bytes binary, in_train boolean, in_other boolean")
    joined, blocks = ({(int(r.pic_a), int(r.pic_b)): r.overlap for r in overlaps.picture_links(df, common=common).collect()} for common in (overlaps.COMMON, 0))
    assert (1, 2) in joined and (1, 3) not in joined and len(joined) > 60
    assert joined.keys() <= blocks.keys() and all(blocks[k] >= joined[k] for k in joined)


def test_every_re_encoding_is_linked(spark):
    pics = [("a", picture(s)) for s in range(60)] + [("b", picture(s, noise=900 + s)) for s in range(60)]
    rows = [{"id": k + 1, "question": "x 1", "bytes": b, "split": "train" if side == "a" else "test"} for k, (side, b) in enumerate(pics)]
    got = {(r.id_a, r.id_b) for r in overlaps.overlapping_rows(qa(spark, rows)).collect()}
    assert got == {(k, k + 60) for k in range(1, 61)}


# Leaks.

ITEM = "Stop sign 4 leans left below the gravelled tram stop, watched by eight elephants. Marker ff-366 hangs above bench 5, where three students queue steadily. Somewhere above Ostwick a lone giraffe blocks the overgrown track to a red tower. Question: Which is the closest bench? Answer: 1."
LIKE = "Stop sign 2 leans right below the windy kiosk, watched by eight zebras. Marker ab-111 hangs above bench 3, where six students queue barely. Somewhere near Dunhurst a lone giraffe blocks the quiet track to a red lamp."


def test_leaks_whole_in_pieces_and_altered(spark):
    filler = " ".join(f"word{k}" for k in range(60))
    docs = [
        (1, ITEM), (2, filler + " marker ff-366 hangs above <b>bench</b> 5, where three students queue now steadily. somewhere above ostwick " + filler), (3, LIKE), (4, "Which is the closest bench? " + filler), (5, "Marker ff-366 hangs above bench"),
        (6, None), (7, ""), (8, filler * 300), (9, "A lone giraffe blocks the overgrown track to a red tower near Ostwick. " + filler + " Stop sign 4 leans left below the gravelled tram stop, watched by many; marker ff-366"), (1, ITEM), (None, ITEM),
    ]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, score int, item_id string")
    i = spark.createDataFrame([(1, ITEM, 5), (2, LIKE + " Question: no?", 5), (3, None, 5), (4, "", 5), (None, ITEM, 5)], "item_id bigint, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked_documents(d, i).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (9, 1)]
    assert leaks.leaked_documents(d.limit(0), i).count() == 0 and leaks.leaked_documents(d, i.limit(0)).count() == 0


def test_leaks_of_descriptions_that_many_items_share(spark):
    d = spark.createDataFrame([(1, ITEM), (2, LIKE), (3, "nothing of the kind")], "doc_id bigint, text string")
    # Copies of one description with other questions: all are found, and the copies make no word common.
    i = spark.createDataFrame([(k, ITEM.replace("Which", f"{k}: Which")) for k in range(40)], "item_id bigint, text string")
    want = [(1, k) for k in range(40)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaked_documents(d, i).collect()) == want
    # No word is rare, but only one description has them in this order.
    words = [f"w{k}" for k in range(24)]
    orders = [words[k:] + words[:k] for k in range(0, 24, 2)] + [random.Random(k).sample(words, 24) for k in range(12)]
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(orders)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, " ".join(orders[20])), (2, " ".join(orders[20][:6]))], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked_documents(d, i).collect())
    assert got == [(1, 20)]


def test_leaks_in_another_unicode_form(spark):
    item = ITEM.replace("Ostwick", "Östwick").replace("steadily", "ständig")
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in item)
    d = spark.createDataFrame([(1, unicodedata.normalize("NFD", item)), (2, wide), (3, LIKE)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, item), (2, unicodedata.normalize("NFD", LIKE))], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaked_documents(d, i).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_seeds_miss_no_leak_that_tiling_all_pairs_finds(spark):
    rng = random.Random(4)
    names = [f"{a}{b}" for a in ("ost", "dun", "kel", "mar", "wex", "hal", "ulm", "nev", "gar", "fal") for b in ("wick", "hurst", "moor", "gate", "den", "lund", "ton", "rick")]
    make = lambda: f"marker {rng.choice(names)}-{rng.randint(100, 999)} hangs above bench {rng.randint(1, 6)} where {rng.choice('two three four five'.split())} students queue near {rng.choice(names)}. between {rng.choice(names)} and {rng.choice(names)} there are twelve elephants, most of them beside a {rng.choice('white red grey blue'.split())} fence."
    texts = [make() for _ in range(60)]

    def altered(t):
        w = t.split()
        a = rng.randint(0, len(w) - 20)
        w = w[a : a + rng.randint(14, 34)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["nearly", "now", "students", "queue"])
        return "Some filler stands here. " + " ".join(w) + " and more filler"

    docs_ = [altered(rng.choice(texts)) for _ in range(150)] + [make() for _ in range(50)]
    d = spark.createDataFrame(list(enumerate(docs_)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in leaks.leaked_documents(d, i).collect()}
    hasher, want, seeds = leaks.Hasher(), {}, {}
    asked = leaks.descriptions(i)
    for r in leaks.seeds_of(asked).collect():
        seeds.setdefault(r.description, []).append((r["at"], r["at"] + r["size"]))
    for r in asked.collect():
        places = {}
        for at, h in enumerate(hasher.windows(hasher.codes_of(r.words))):
            places.setdefault(h, []).append(at)
        for k, t in enumerate(docs_):
            words = leaks.words_of(t)
            n = leaks.score(r.words, words, places, hasher.windows(hasher.codes_of(words)), seeds.get(r.description, []))
            if n >= leaks.needed(len(r.words)):
                want[k, r.description] = n
    assert got == want and len(want) > 100


def test_leaks_of_descriptions_whose_phrases_many_others_share(spark):
    # 36 descriptions of two out of six sentences; every run of 13 words is in six or more of them, and no word is rare.
    part = [f"near a gate by the old road {w} queue under tall trees at dawn" for w in "one two three four five six".split()]
    texts = [f"{a} {b}" for a in part for b in part]
    docs_ = [f"Some filler stands here. {texts[8]} Then more filler.", f"Filler again {part[1]} and on it goes.", "near a gate by the old road seven queue under tall trees at dawn"]
    d = spark.createDataFrame(list(enumerate(docs_)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_documents(d, i).collect()} == {(0, 8)}


def test_tiles_are_the_longest_first():
    a, b = "a b c d e f g h".split(), "e f g h x a b c d y b c d".split()
    at, hasher = {}, leaks.Hasher()
    for k, h in enumerate(hasher.windows(hasher.codes_of(a))):
        at.setdefault(h, []).append(k)
    assert sorted(leaks.tiles(a, b, at, hasher.windows(hasher.codes_of(b)))) == [(0, 5, 4), (4, 0, 4)]


# Mixing.


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, T0, 1.0, 2) for i, s, t in rows], "doc_id bigint, source string, text string, collected_at timestamp, finish double, tokens int")


def test_mix_gives_targets_and_names_dry_sources(spark):
    text = "the quick brown fox jumps over the lazy dog " * 4
    d = docs(spark, [(k, "Big Source" if k % 2 else "big_source", text) for k in range(200)] + [(500 + k, "small", text) for k in range(10)] + [(900, None, text), (901, "small", None), (902, "small", ""), (1, "big-source", text)])
    targets = spark.createDataFrame([(1, "big_source", 0.6, 1, 0.8), (1, "small", 0.4, 3, 0.8), (1, "none", 0.1, 2, 0.8), (2, "small", 0.03, 2, 1.0), (None, "x", 1.0, 1, 1.0), (2, None, 1.0, 1, 1.0), (2, "big_source", None, None, 1.0)], "mix_id int, source string, target_share double, max_repeats int, mix_ratio double")
    assert sorted(tuple(r) for r in mixture.dry_sources(d, targets).collect()) == [(1, "none"), (1, "small")]
    got = mixture.mix(d, targets).toPandas()
    small = got[(got.mix_id == 1) & (got.source == "small")]
    assert small.groupby("doc_id").size().max() == 3 and len(small) == 30
    rep = {(r.mix_id, r.source): r for r in mixture.mix_report(d, targets).collect()}
    assert rep[1, "none"].given_tokens == 0 and rep[2, "small"].reached_share == 1.0 and rep[2, "big_source"].given_tokens == 0
    assert mixture.mix(d.limit(0), targets).count() == 0 and mixture.dry_sources(d, targets.limit(0)).count() == 0


def test_mix_is_cut_at_its_budget(spark):
    text = "the quick brown fox jumps over the lazy dog " * 4
    d = docs(spark, [(k, "big", text) for k in range(200)] + [(500 + k, "small", text) for k in range(10)])
    targets = spark.createDataFrame([(1, "big", 0.6, 1, 0.8), (1, "small", 0.4, 3, 0.8), (2, "big", 0.9, 1, 0.5), (2, "small", 0.6, 9, 0.5), (3, "small", 1.0, 2, 1.0)], "mix_id int, source string, target_share double, max_repeats int, mix_ratio double")
    got = mixture.mix(d, targets).toPandas()
    assert got[got.mix_id == 1].source.value_counts().to_dict() == {"big": 138, "small": 30}  # 168 copies in all
    assert len(got[got.mix_id == 2]) == 105 and len(got[got.mix_id == 3]) == 20
    rep = {(r.mix_id, r.source): r for r in mixture.mix_report(d, targets).collect()}
    assert abs(rep[1, "big"].reached_share - 138 / 168) < 1e-9 and rep[1, "small"].dry and rep[3, "small"].reached_share == 1.0


def test_mix_equals_serving_one_by_one(spark):
    rng = random.Random(5)
    d = docs(spark, [(k, rng.choice("abc"), "word " * rng.randint(1, 90)) for k in range(150)])
    targets = spark.createDataFrame([(m, s, rng.random(), rng.randint(1, 2000), r) for m, r in enumerate((0.1, 0.7, 2.0, 9.0)) for s in "abc"], "mix_id int, source string, target_share double, max_repeats int, mix_ratio double")
    sized = mixture.sized_documents(d)
    lane = mixture.lanes(sized, targets)
    got = mixture.mix(d, targets).toPandas()
    every = mixture.schedule(sized, lane.withColumn("stop", F.col("end"))).toPandas()  # all copies that are allowed
    for m, rows in every.groupby("mix_id"):
        rows = rows.sort_values(["finish", "source", "doc_id", "copy"])
        want = rows[rows.tokens.cumsum() <= rows.budget.iloc[0]]
        mine = got[got.mix_id == m]
        assert set(zip(want.doc_id, want["copy"])) == set(zip(mine.doc_id, mine["copy"])) and len(want)
    assert len(every) > 3 * len(got)


def test_tokens_of_long_texts_are_those_of_the_whole(spark):
    texts = ["", "a" * 200_000, "word " * 40_000, "\n" * 70_000 + "x", " " * 60_001]
    got = [r.tokens for r in mixture.sized_documents(docs(spark, [(k, "s", t) for k, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == [len(mixture.encoding(mixture.TOKENIZER).encode_ordinary(t)) for t in texts]


# Subjects.

CARE = "The vet examined a hoof on the giraffe called Fenden. Dung samples from nine elephants went to the laboratory. Keepers feed the elephant hay by noon. "
LAW = "The contract with Garwick grants reuse rights. Clause 5 limits the liability of Garwick for torn drawings. Our lawyer finds the terms too wide. "


def test_subjects_of_documents(spark):
    d = docs(spark, [(k, "a", CARE) for k in range(30)] + [(100 + k, "b", LAW) for k in range(30)] + [(200 + k, None, CARE + LAW) for k in range(15)] + [(300 + k, "a", CARE + "Clause 5 limits the liability of Garwick for torn drawings.") for k in range(10)] + [(900, "a", None), (901, "a", "  "), (902, "a", "Nothing else happened until noon. " * 3000), (1, "a", CARE)])
    areas = spark.createDataFrame([("animal_care", "x"), ("licensing_law", "y"), (None, "z")], "subject_area string, description string")
    rated = [(k, "animal_care") for k in (0, 1, 2, 3, 200, 201)] + [(k, "licensing_law") for k in (*range(100, 108), 200, 201, 4)] + [(5, "unknown"), (None, "animal_care"), (7, None), (902, "licensing_law"), (0, "animal_care")]
    ratings = spark.createDataFrame(rated, "doc_id bigint, subject_area string")
    nothing = spark.createDataFrame([("Nothing else happened until noon.",), (None,), ("",)], "text string")
    got = {}
    for r in subjects.assigned_subjects(d, areas, ratings, nothing).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_area)
    assert {k: v for k, v in got.items() if k < 30 or k >= 300} == {k: {"animal_care"} for k in [*range(30), *range(300, 310)]}
    assert all(got[k] == {"licensing_law"} for k in range(100, 130)) and all(got[k] == {"animal_care", "licensing_law"} for k in range(200, 215))
    assert not {900, 901, 902} & set(got)
    assert subjects.assigned_subjects(d.limit(0), areas, ratings, nothing).count() == 0
    rep = {r.subject_area: r for r in subjects.subject_report(d, areas, ratings, nothing).collect()}
    assert (rep["animal_care"].rated, rep["animal_care"].agreed, rep["licensing_law"].rated, rep["licensing_law"].agreed) == (6, 6, 12, 10)


def test_areas_without_ratings_are_known_by_their_description(spark):
    bees = "The beekeeper checked the hives before noon. Honey from both hives was sold by the beekeeper. "
    d = docs(spark, [(k, "a", CARE) for k in range(30)] + [(100 + k, "b", bees) for k in range(30)])
    areas = spark.createDataFrame([("zoo", "Hooves, hay and keepers, elephants"), ("apiary", "Beekeeper and hives, honey")], "subject_area string, description string")
    got = {(r.doc_id, r.subject_area) for r in subjects.assigned_subjects(d, areas).collect()}
    assert got == {(k, "zoo") for k in range(30)} | {(100 + k, "apiary") for k in range(30)}
    with pytest.raises(ValueError):
        subjects.assigned_subjects(d, spark.range(1001).selectExpr("'a' || id as subject_area", "'x' as description"))
    assert subjects.assigned_subjects(d, areas.limit(0)).count() == 0


def test_wrapped_lines_and_stamps_are_single_sentences():
    assert subjects.sentences("> black, the bridge\n> stands here. Next\n> one.\n\n- item one\n* item two\n[08:28] Stamped.") == ["black, the bridge stands here.", "Next one.", "item one", "item two", "Stamped."]


def test_reliability_is_learned_from_agreement():
    post = subjects.fit_reliability({(1, 1, 1, 0): 500, (-1, -1, -1, 0): 500, (1, 1, -1, 1): 20, (-1, -1, 1, -1): 20})
    assert post[1, 1, 1, 0] > 0.9 > 0.1 > post[-1, -1, -1, 0] and post[1, 1, -1, 1] > 0.5 > post[-1, -1, 1, -1]
