"""Writers: bounded archives, tables with a header of all columns, logs, cleaned JSON and detection relations."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ensemble import CORNERS, taken, takers_served
from quillon.operators.ordered import dense_position, ordered_running
from quillon.session import cut

# Keys that hold paths and are taken out of published JSON.
PATH_KEYS = {"adapter_path", "best_checkpoint_path", "best_model_checkpoint", "output_dir", "predictions_csv", "predictions_json"}


def rolled(rows: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """``rows`` with ``shard`` by the roll-over rule of archives: a new one begins after the row that brings the size over ``most``.

    The size starts anew in every shard, so no running sum tells it. From the running sum of all, each
    row knows at which row a shard that began there would end: the first whose sum is more than ``most`` higher, found
    by sorting both together. The shards that do begin are those reached from the first row, by
    jumps of doubled length. Null sizes count as 0.
    """
    bytes_ = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    placed = dense_position(rows, [order], "_pos")
    summed = cut(ordered_running(placed.select("_pos", bytes_.alias("_s"), F.lit(1).alias("_one")), ["_one"], ["_pos"], "_s", "_upto").select("_pos", "_s", "_upto"))
    asks = summed.select((F.col("_upto") - F.col("_s") + most).alias("v"), F.lit(0).alias("kind"), F.col("_pos").alias("start"), F.lit(None).cast("bigint").alias("end"))
    # A sum equal to what is asked is not over it, so it sorts before the question.
    sums = summed.select(F.col("_upto").alias("v"), F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("start"), F.col("_pos").alias("end"))
    both = cut(asks.unionByName(sums).repartitionByRange("v", "kind").withColumn("_pid", F.spark_partition_id()))
    later = both.groupBy("_pid").agg(F.min("end").alias("e"))
    after = F.broadcast(later.select("_pid", F.min("e").over(Window.orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)).alias("after")))  # one row per partition
    here = F.min("end").over(Window.partitionBy("_pid").orderBy(F.desc("v"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    jumps = cut(both.withColumn("here", here).where("kind = 0").join(after, "_pid").select("start", (F.coalesce("here", "after") + 1).alias("next")).where("next is not null"))
    begun = cut(summed.where("_pos = 0").select(F.col("_pos").alias("start")))
    while True:
        reached = begun.join(jumps, "start").select(F.col("next").alias("start"))
        grown = cut(begun.union(reached).distinct())
        if grown.count() == begun.count():
            break
        far = jumps.select(F.col("start").alias("next"), F.col("next").alias("far"))
        begun, jumps = grown, cut(jumps.join(far, "next").select("start", F.col("far").alias("next")))
    numbers = dense_position(begun, ["start"], "shard").select(F.col("start").alias("_pos"), F.lit(1).alias("_new"))
    marked = placed.join(numbers, "_pos", "left").withColumn("_one", F.lit(1))
    return ordered_running(marked, ["_one"], ["_pos"], "_new", "shard").withColumn("shard", F.col("shard") - 1).drop("_pos", "_new", "_one")


def write_archives(rows: DataFrame, folder: str, name: str, content: str) -> None:
    """A TAR file per ``shard`` of rows (shard, ``name``, ``content``); a shard is bounded by ``rolled``. The folder must be shared by all executors."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/shard-{int(key[0]):06d}.tar"
        with tarfile.open(path + ".part", "w") as tar:
            for n, data in zip(pdf[name], pdf[content]):
                info = tarfile.TarInfo(n)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        os.replace(path + ".part", path)
        return pd.DataFrame([(int(key[0]), len(pdf))], columns=["shard", "files"])

    rows.groupBy("shard").applyInPandas(write, "shard bigint, files bigint").collect()  # one row per archive


def write_csv(parts: list[DataFrame], path: str) -> list[str]:
    """Rows of several forms as CSV with a header of all their columns in the order in which they first appear; gives the header."""
    header = list(dict.fromkeys(c for df in parts for c in df.columns))
    if not parts:
        return header
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.select(*header).write.mode("overwrite").option("header", True).csv(path)
    return header


def log_rows(rows: DataFrame, path: str, time: str = "timestamp") -> None:
    """Appends rows to a log of JSON lines, with the time of writing where they have none; a log's columns are the union of all its rows'."""
    stamped = rows.withColumn(time, F.coalesce(F.col(time), F.current_timestamp()) if time in rows.columns else F.current_timestamp())
    stamped.write.mode("append").json(path)


def without_paths(text: str) -> object:
    """The value of a JSON text, keys that hold paths left out at any depth."""
    return json.loads(text, object_pairs_hook=lambda pairs: dict(p for p in pairs if p[0] not in PATH_KEYS))


def cleaned_json(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the JSON of ``column`` without paths; texts that are no JSON stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(without_paths(t), ensure_ascii=False)
            except ValueError:
                return t

        return pd.Series([one(t) for t in texts], dtype=object)

    return rows.withColumn(column, clean(column))


def write_json(value: object, path: str) -> None:
    """A report as indented JSON."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def coco(truth: DataFrame, found: DataFrame, confidence: float = 0.0, first_images: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, detections) of boxes (image_id, det_idx, cls, score, x1..y2, img_w, img_h) in the form of detection benchmarks.

    Images and annotations are numbered densely from 1; boxes are upper left corner and size, areas 0 as such files have them; detections
    below ``confidence`` are left out.
    """
    both = truth.select("image_id", "img_w", "img_h").unionByName(found.select("image_id", "img_w", "img_h")).groupBy("image_id").agg(F.max("img_w").alias("width"), F.max("img_h").alias("height"))
    if first_images is not None:
        both = both.orderBy("image_id").limit(first_images)
    images = dense_position(both, ["image_id"], "_k").select((F.col("_k") + 1).alias("id"), "image_id", "width", "height")
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox")
    ids = images.select("image_id", F.col("id").alias("image"))
    kept = truth.join(ids, "image_id")
    annotations = dense_position(kept, ["image", "det_idx"], "_k").select((F.col("_k") + 1).alias("id"), "image", F.col("cls").alias("category_id"), box, F.lit(0.0).alias("area"), F.lit(0).alias("iscrowd"))
    detections = found.where(F.col("score") >= confidence).join(ids, "image_id").select("image", F.col("cls").alias("category_id"), box, "score")
    return images, annotations, detections


def key_value_store(qa: DataFrame, key: str) -> DataFrame:
    """(question_type, key, value): JSON {qa_list, split, num of labels} of each key and type, pairs in the order of their id."""
    per = qa.groupBy("question_type", F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct("id", "question", "answer"))).alias("l"), F.max("split").alias("split"), F.max("n_labels").alias("n"))
    pairs = F.transform("l", lambda x: F.array(x["question"], x["answer"]))
    return per.select("question_type", "key", F.to_json(F.struct(pairs.alias("qa_list"), "split", F.col("n").alias("num of labels"))).alias("value"))


def finished(results: DataFrame, table: str, least: int) -> DataFrame:
    """The tables that hold at least so many scores and need no further run."""
    return results.groupBy(table).agg(F.count("score").alias("n")).where(F.col("n") >= least).select(table)


def matched_boxes(truth: DataFrame, found: DataFrame, iou: float = 0.5) -> DataFrame:
    """(image_id, label, det_idx, score, hit): the found boxes of an image and label, in the order of their scores, each taking the best free true box of enough overlap.

    Both have (image_id, label, det_idx, x1..y2), ``found`` also score.
    """
    got = taken(found, truth, iou, F.col("score"))
    return got.select("image_id", "label", "det_idx", "score", F.col("iou").isNotNull().cast("int").alias("hit"))


def image_measures(truth: DataFrame, found: DataFrame, iou: float = 0.5) -> DataFrame:
    """(image_id, hits, false_alarms, missed) of each image with a true or found box, matched as by ``matched_boxes``."""
    box = ["image_id", "label", "det_idx", *CORNERS]
    true = truth.select(*box, F.lit(None).cast("double").alias("score"), F.lit(True).alias("true"), F.lit(False).alias("found"))
    return marked_measures(true.unionByName(found.select(*box, "score", F.lit(False).alias("true"), F.lit(True).alias("found"))), iou)


def marked_measures(boxes: DataFrame, iou: float = 0.5) -> DataFrame:
    """``image_measures`` of one table whose boxes are marked ``true``, ``found`` or both.

    Needs one order by image: boxes partitioned and sorted by image_id are read as they are, and a batch of images is matched at once.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The batches cut anew, so that no image is in two."""
        held: list[pa.RecordBatch] = []
        for b in (b for b in batches if b.num_rows):
            last = b.column("image_id")[-1]
            same = pc.is_null(b.column("image_id")) if not last.is_valid else pc.fill_null(pc.equal(b.column("image_id"), last), False)
            at = pc.index(same, True).as_py()
            if held and (at or held[-1].column("image_id")[-1] != last):
                yield pa.Table.from_batches([*held, b.slice(0, at)])
                held = []
            elif at:
                yield pa.Table.from_batches([b.slice(0, at)])
            held.append(b.slice(at))
        if held:
            yield pa.Table.from_batches(held)

    def measured(t: pa.Table) -> pa.RecordBatch:
        number = lambda c, null: pc.fill_null(t[c], null).to_numpy()
        ids, unknown = number("image_id", 0), pc.is_null(t["image_id"]).to_numpy()
        begins = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (unknown[1:] != unknown[:-1])])
        image = np.zeros(len(ids), int)
        image[begins[1:]] = 1
        image = image.cumsum()
        labels = t["label"].combine_chunks().dictionary_encode()
        label = pc.fill_null(labels.indices, len(labels.dictionary)).to_numpy().astype(int)
        corners = np.column_stack([number(c, float("nan")) for c in CORNERS])
        place = np.where(pc.is_null(t["det_idx"]).to_numpy(), np.iinfo(int).min, number("det_idx", 0).astype(int))
        true, found = number("true", False), number("found", False)
        hit = takers_served(image * (len(labels.dictionary) + 1) + label, found, true, number("score", float("nan")), place, corners, iou)
        h, f, n = (np.bincount(image[x], minlength=len(begins)) for x in (hit, found, true))
        return pa.RecordBatch.from_arrays([t["image_id"].combine_chunks().take(pa.array(begins)), *map(pa.array, (h, f - h, n - h))], ["image_id", "hits", "false_alarms", "missed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(measured, whole(batches))

    rows = boxes.select("image_id", "label", F.col("det_idx").cast("bigint").alias("det_idx"), *[F.col(c).cast("double").alias(c) for c in ("score", *CORNERS)], "true", "found").where(F.col("true") | F.col("found"))
    return rows.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, "image_id bigint, hits bigint, false_alarms bigint, missed bigint")


def average_precision(truth: DataFrame, found: DataFrame, iou: float = 0.5) -> DataFrame:
    """(label, truths, ap) at one IoU: boxes of an image and label are matched in the order of their scores, the precision is made to fall and averaged at 101 recalls.

    Both have (image_id, label, det_idx, x1..y2), ``found`` also score. Labels without a true box have no row. Per label
    precision and recall are running sums over the detections in the order of scores.
    """
    hits = matched_boxes(truth, found, iou)
    total = truth.groupBy("label").agg(F.count(F.lit(1)).alias("truths"))
    # Sums by score first, so that a label with most of all boxes is one window of distinct scores, not of boxes.
    per = hits.groupBy("label", "score").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("score"))
    run = per.withColumn("tp", F.sum("h").over(w)).withColumn("seen", F.sum("n").over(w)).join(total, "label")
    run = run.withColumn("recall", F.col("tp") / F.col("truths")).withColumn("precision", F.col("tp") / F.col("seen"))
    points = run.withColumn("best", F.max("precision").over(Window.partitionBy("label").orderBy("score")))  # the best at this recall or more
    # Each of 101 recalls takes the best precision at the first point that reaches it.
    before = F.coalesce(F.lag("recall").over(w), F.lit(-1.0))
    level = lambda r: F.floor(r * 100 + 1e-9)
    gained = level(F.col("recall")) - F.when(before < 0, F.lit(-1)).otherwise(level(before))
    ap = points.withColumn("g", gained).groupBy("label").agg((F.sum(F.col("g") * F.col("best")) / 101).alias("ap"))
    return total.join(ap, "label", "left").select("label", "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_average_precision(truth: DataFrame, found: DataFrame, ious: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """(iou, map): the mean over labels at each IoU."""
    out = None
    for t in ious:
        rows = average_precision(truth, found, t).agg(F.avg("ap").alias("map")).select(F.lit(t).alias("iou"), "map")
        out = rows if out is None else out.unionByName(rows)
    return out
