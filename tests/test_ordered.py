from pyspark.sql import functions as F

from quillon.operators.chat import qa_pairs
from quillon.operators.ordered import dense_position, hash_running


def test_hash_running_is_a_rank_and_a_running_sum(spark):
    rows = [("a", i, i % 7) for i in range(300)] + [(None, i, None) for i in range(5)] + [("b", 1, 4)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    out = hash_running(df, ["g"], ["k"], "v", buckets=8, total="t").toPandas()
    a = out[out.g == "a"].sort_values("rank")
    assert list(a["rank"]) == list(range(1, 301))
    assert list(a.t) == list(a.v.cumsum())
    assert sorted(out[out.g.isna()]["rank"]) == [1, 2, 3, 4, 5]
    assert out.columns.tolist() == ["g", "k", "v", "rank", "t"]


def test_hash_running_of_nothing(spark):
    assert hash_running(spark.createDataFrame([], "g string, k int"), ["g"], ["k"]).count() == 0


def test_dense_position_is_the_order(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("x"))
    out = dense_position(df, ["x"], "p", 5).toPandas().sort_values("x")
    assert list(out.p) == list(range(1000))
    assert dense_position(df.limit(0), ["x"]).count() == 0


def test_a_later_user_turn_replaces_and_other_roles_are_ignored(spark):
    turns = [(1, 1, "user", "u1"), (1, 2, "user", "u2"), (1, 3, "system", "s"), (1, 4, "assistant", "a1"), (1, 5, "assistant", "a2"), (1, 6, "user", "u3"), (2, 1, "user", " "), (2, 2, "assistant", "x"), (3, 1, "user", None)]
    out = qa_pairs(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()
    assert [tuple(r) for r in out] == [(1, 4, "u2", "a1")]


def test_joins_beyond_their_bound_are_salted(spark):
    from quillon.operators.joins import bounded_join

    big = spark.createDataFrame([(k, "hot" if k % 3 else "cold") for k in range(90)] + [(91, None), (92, "none")], "id int, key string")
    small = spark.createDataFrame([("hot", 1), ("cold", 2), ("hot", 3)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, big.join(small, ["key"], how).collect()), key=str)
        for most in (10, 1):
            assert sorted(map(tuple, bounded_join(big, small, ["key"], how, most=most).collect()), key=str) == want
