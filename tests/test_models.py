from pyspark.sql import functions as F

from quillon import __main__ as cli
from quillon.operators import models as M


def test_models_over_batches(spark):
    # Made here, so that they travel with the task.
    detector = lambda: lambda part: [(int(i), 0, len(c), "x", 0.5, 0.0, 0.0, 1.0, 1.0) for i, c in zip(part.image_id, part.content) if len(c)]
    masks = lambda: lambda part: [(int(i), int(k), bytes(c)) for i, k, c in zip(part.image_id, part.det_idx, part.content)]
    images = spark.createDataFrame([(k, b"a" * k) for k in range(5)], "image_id bigint, content binary")
    det = M.detected(images, "d", detector)
    assert [r.cls for r in det.orderBy("image_id").collect()] == [1, 2, 3, 4]
    assert M.segmented(images, det, "m", masks).where(F.length("mask") == F.col("image_id")).count() == 4
    assert M.detected(images.limit(0), "d", detector).count() == 0


def test_answers_are_asked_for_once(spark):
    teller = lambda: lambda part: [(p, f"fresh {p}") for p in part.prompt]
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, prompt string")
    cache = spark.createDataFrame([("t", "b", "stored"), ("other", "a", "wrong")], "model string, prompt string, answer string")
    assert {tuple(r) for r in M.answered(p, "t", teller, cache).collect()} == {(1, "fresh a"), (2, "fresh a"), (3, "stored")}
    assert M.answered(p, "t", teller).where("answer like 'fresh%'").count() == 3


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "count_people" in capsys.readouterr().out
    assert cli.main(["run", "count_people", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
