from pyspark.sql import functions as F

from quillon.streaming import log as L

TABLE = {"idle": (("seen",), {("go",): "drive"}), "drive": (("seen", "near"), {("go", "yes"): "stop"})}
ROWS = [("r", 1, "seen", "go"), ("r", 2, "near", "no"), ("r", 3, "near", "yes"), ("r", 3, "near", "no"), ("q", 1, "seen", "x"), (None, 1, "seen", "go")]
WANT = [("q", 1, "idle"), ("r", 1, "drive"), ("r", 2, "drive"), ("r", 3, "stop")]
SCHEMA = "run_id string, seq bigint, obs_key string, answer string"


def test_machine_on_a_batch(spark):
    out = L.run_machine(spark.createDataFrame(ROWS, SCHEMA), TABLE, "idle").collect()
    assert sorted((r.run_id, r.seq, r.state) for r in out) == WANT


def test_machine_on_a_stream_keeps_state_between_files(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame([r for r in ROWS if (r[1] == 1) == (k == 0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    log = L.read_log(spark, src, SCHEMA, files_per_batch=1)
    q = L.run_machine(log, TABLE, "idle").writeStream.format("memory").queryName("machine").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    out = spark.table("machine").collect()
    assert sorted((r.run_id, r.seq, r.state) for r in out) == WANT


def test_windows_and_newest(spark):
    df = spark.createDataFrame([("a", "2025-01-01 00:10:00", 1), ("a", "2025-01-01 00:50:00", 0), ("b", "2025-01-01 02:00:00", 1)], "k string, t string, c int").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.key, r.n, r.accuracy) for r in L.windowed_accuracy(df, time="t", key="k", correct="c").collect()) == [("a", 2, 0.5), ("b", 1, 1.0)]
    assert sorted((r.k, r.c) for r in L.newest(df, "k", "t", ["c"]).collect()) == [("a", 0), ("b", 1)]


def test_derived_observations(spark):
    from quillon.streaming import log as L

    table = {"drive_to_stop": (("arrived",), {("yes",): "view"}), "view": (("waited", "all_visited"), {("yes", "no"): "drive_to_stop", ("yes", "yes"): "end"})}
    rows = [("r", 0, "stops", "3, 1"), ("r", 1, "arrived", "yes"), ("r", 2, "waited", "yes"), ("r", 3, "arrived", "no"), ("r", 4, "arrived", "yes"), ("r", 5, "waited", "yes")]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, obs_key string, answer string")
    got = [r.state for r in L.run_machine(df, table, "drive_to_stop", derive=L.stops_left).orderBy("seq").collect()]
    assert got == ["drive_to_stop", "view", "drive_to_stop", "drive_to_stop", "view", "end"]
