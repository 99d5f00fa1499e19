"""Writers: numbered QA rows, conversations as JSON lines and label text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import dense_position


def numbered(qa: DataFrame, order: list[str]) -> DataFrame:
    """``qa`` with dense ids from 0 in the given order, without bringing the rows into one task."""
    return dense_position(qa, order, "id")


def write_qa(qa: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    qa.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def conversations(qa: DataFrame) -> DataFrame:
    """(value): JSON lines {image, conversations: [{value}, {value}], question_type}; the image is named by the first 16 digits of its SHA-256."""
    image = F.concat(F.substring(F.sha2("image.bytes", 256), 1, 16), F.lit(".jpg"))
    talk = F.array(F.struct(F.col("question").alias("value")), F.struct(F.col("answer").alias("value")))
    return qa.where("image.bytes is not null").select(F.to_json(F.struct(image.alias("image"), talk.alias("conversations"), "question_type")).alias("value"))


def label_text(det: DataFrame) -> DataFrame:
    """(image_id, text): a line 'cls xc yc w h' per box, centre and size over the image size, in the order of det_idx."""
    c = F.col
    six = lambda x: F.floor(x * 1e6 + 0.5) / 1e6  # noqa: E731  halves go up before they are written
    line = F.format_string("%d %.6f %.6f %.6f %.6f", c("cls"), six((c("x1") + c("x2")) / 2 / c("img_w")), six((c("y1") + c("y2")) / 2 / c("img_h")), six((c("x2") - c("x1")) / c("img_w")), six((c("y2") - c("y1")) / c("img_h")))
    rows = det.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", line.alias("t")))).alias("l"))
    return rows.select("image_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``work`` isn't in ``done`` yet: resuming by anti-join."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
