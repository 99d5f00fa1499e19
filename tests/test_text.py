import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import metrics


def one(spark, make, *values):
    cols = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], cols).select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize("text, want", [(" The answer is  2 ,  1 , 4.", "2,1,4"), (None, ""), ("Answer: It is North!", "north"), ("There are\t3;", "3"), (" Yes ", "yes")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_answer, text) == want


@pytest.mark.parametrize("text, want", [("Yes, it is", ("yes", "first_token")), ("maybe yes or no", (None, "unparsed")), ("it is true", ("yes", "single_keyword")), (None, (None, "unparsed"))])
def test_yes_no(spark, text, want):
    assert tuple(one(spark, T.yes_no, text)) == want


@pytest.mark.parametrize("text, want", [("(B) because", ("B", "letter")), ("Option c", ("C", "letter")), ("it shows the dog is on the mat", ("B", "caption_match")), ("nothing", (None, "unparsed"))])
def test_letter(spark, text, want):
    options = F.array(F.lit("a cat"), F.lit("the dog is on the mat"))
    assert tuple(one(spark, lambda t: T.letter(t, options), text)) == want


@pytest.mark.parametrize("text, points, how", [("(50, 20)", [(0.5, 0.2)], "literal"), ("[(0.1, 0.2)]", [(0.1, 0.2)], "literal"), ("at (50, 20) or (0.1, 0.2)", [(0.5, 0.2), (0.1, 0.2)], "regex_pairs"), ("x 0.3 y 0.4", [(0.3, 0.4)], "loose_numbers"), ("none", [], "unparsed")])
def test_points(spark, text, points, how):
    r = one(spark, T.points, text)
    assert ([tuple(p) for p in r.points], r.method) == (points, how)


@pytest.mark.parametrize("text, want", [("about 30 cm", 0.30), ("2 feet", 0.6096), ("5 mm", 0.005), ("12", 12.0), ("none", None)])
def test_metres(spark, text, want):
    got = one(spark, T.metres, text)
    assert got == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("gold, said, want", [("2 meters", "2.2 m", 1), ("2 meters", "3 m", 0), ("Yes", "correct, it is", 1), ("on the left", "left side", 1), ("a", "b", 0), (None, None, 1)])
def test_relaxed(spark, gold, said, want):
    assert one(spark, T.relaxed_correct, gold, said) == want


def test_robot_replies(spark):
    assert one(spark, T.reply_int, "assistant: bench -2") == -2
    assert one(spark, T.reply_ids, "None") == []
    assert one(spark, T.reply_turn, "Already facing.") == "already facing"
    assert one(spark, T.reply_compass, "north-east") == "Northeast"
    assert one(spark, T.reply_egocentric, "front left") == "front-left"
    assert one(spark, T.reply_yes_no, "n") == "no"
    assert one(spark, T.final_answer, '{"final_answer": "4"}') == "4"
    assert one(spark, T.final_answer, "so ```x``` it") == "x"


def test_metric_tables(spark):
    rows = [("A", "g", "left of", 1), ("A", "g", "right of", 1), ("A", "g", "on", 0), ("A", "g", "under", 1)]
    df = spark.createDataFrame(rows, "question_type string, group_key string, p string, is_correct int").withColumn("preposition", T.preposition(F.col("p")))
    got = {r.metric: (r.value, r.n) for r in metrics.pair_set_accuracy(df).collect()}
    assert got == {"pair_accuracy": (0.5, 2), "set_accuracy": (0.0, 1)}
    none = {r.metric: r.value for r in metrics.pair_set_accuracy(df.limit(0)).collect()}
    assert none == {"pair_accuracy": None, "set_accuracy": None}
    assert {r.metric: r.value for r in metrics.seen_unseen(df.limit(0)).collect()} == {"overall_accuracy": 0.0, "seen_accuracy": 0.0, "unseen_accuracy": 0.0}


def test_dataset_statistics(spark):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    rows = [(1, "CountPeople", "zoo_bus_1.png", "Train", "1"), (2, "count people", "x/ZOO-BUS-0001_v2.PNG", "val", "2"), (2, "count people", "x/ZOO-BUS-0001_v2.PNG", "val", "2"), (3, "ClosestBench", "zoo_bus_2.png", "TESTING", "2"), (4, None, None, None, "2"), (5, "Closest-Bench-With-Person", "zoo_bus_3.png", "training", None)]
    qa = spark.createDataFrame([(*r, t) for r in rows], "id int, question_type string, source_id string, split string, answer string, ingested_at timestamp")
    got = {r.question_type: r for r in metrics.dataset_stats(qa).collect()}
    assert set(got) == {"*", "countpeople", "closestbench", "closestbenchwithperson"}
    assert (got["countpeople"].qa_pairs, got["countpeople"].images, got["countpeople"].train, got["countpeople"].evaluation, got["countpeople"].train_images) == (2, 1, 1, 1, 1)
    assert (got["*"].qa_pairs, got["*"].images, got["*"].test_images) == (5, 3, 1) and abs(got["countpeople"].share - 0.4) < 1e-9
    assert [(r.answer, r["rank"]) for r in metrics.top_answers(qa).where("question_type = 'countpeople'").orderBy("rank").collect()] == [("1", 1), ("2", 2)]
    assert metrics.dataset_stats(qa.limit(0)).first().qa_pairs in (0, None)
    leaked = metrics.qa_once(qa).where(F.col("question_type").isin(*[h.lower() for h in metrics.HELD_OUT]) & (F.col("split") == "train")).collect()
    assert [r.id for r in leaked] == [5]
