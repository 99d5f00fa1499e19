"""Readers of annotated driving datasets: tables linked by tokens, image and box files with common keys, segmentation masks, and configurations."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.generate import category_id, validate_labels
from quillon.sources.formats import image_folder, register

LOG = logging.getLogger(__name__)
KEYS = ["segment", "timestamp_micros", "camera"]
WORKING_HOURS = (8, 18)

# Names of categories by dataset, to the category they stand for.
CATEGORY_MAPS = {
    "bdd": {"pedestrian": "person", "rider": "person", "motor": "motorcycle", "bike": "bicycle"},
    "nuimages": {"human.pedestrian.adult": "person", "human.pedestrian.child": "person", "vehicle.car": "car", "vehicle.truck": "truck", "vehicle.bus.rigid": "bus", "vehicle.bus.bendy": "bus", "vehicle.motorcycle": "motorcycle", "vehicle.bicycle": "bicycle"},
}
WAYMO_TYPES = {0: "undefined", 1: "car", 2: "person", 3: "stop sign", 4: "bicycle"}


def by_token(rows: DataFrame, name: str, value: object) -> DataFrame:
    """The rows whose ``name`` is ``value``."""
    return rows.where(F.col(name) == F.lit(value))


def mapped_category(name: Column, dataset: str, original: bool = True) -> Column:
    """(label, cls): a dataset's category as it is, or as the general category it stands for.

    With ``original`` off every category whose id is 0 is called person.
    """
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_MAPS[dataset].items() for x in kv])
    general = F.coalesce(F.try_element_at(known, name), name)
    cls = F.coalesce(category_id(general), F.lit(-1))
    return F.struct(F.when(F.lit(original), name).when(cls == 0, "person").otherwise(general).alias("label"), cls.alias("cls"))


def time_in_name(name: Column) -> Column:
    """The hour of a file name with its date and time ('...2018-07-24-11-22-...'), null without one."""
    return F.nullif(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}-(\d{2})-(\d{2})-", 1), F.lit("")).cast("int")


def nuimages(samples: DataFrame, annotations: DataFrame, categories: DataFrame, attributes: DataFrame | None = None, *, by_day: bool = False) -> DataFrame:
    """(sample_token, file_name, objects) of tables linked by tokens; samples without objects are left out.

    ``samples`` (token, file_name), ``annotations`` (sample_token, category_token, attribute_tokens, bbox),
    ``categories`` and ``attributes`` (token, name): small tables of fixed size, looked up. ``by_day``
    keeps files from 8 to 18 o'clock.
    """
    rows = annotations.join(F.broadcast(categories.select(F.col("token").alias("category_token"), F.col("name").alias("category"))), "category_token")  # a few dozen categories
    if attributes is not None:
        named = rows.select("sample_token", "category", "bbox", F.explode_outer("attribute_tokens").alias("token")).join(F.broadcast(attributes.select("token", F.col("name").alias("attribute"))), "token", "left")  # a few dozen attributes
        rows = named.groupBy("sample_token", "category", "bbox").agg(F.sort_array(F.collect_set("attribute")).alias("attributes"))
    else:
        rows = rows.withColumn("attributes", F.array().cast("array<string>"))
    per = rows.groupBy("sample_token").agg(F.array_sort(F.collect_list(F.struct("category", "bbox", "attributes"))).alias("objects"))
    out = samples.select(F.col("token").alias("sample_token"), "file_name").join(per, "sample_token")
    return out.where(time_in_name(F.col("file_name")).between(WORKING_HOURS[0], WORKING_HOURS[1] - 1)) if by_day else out


def waymo(images: DataFrame, boxes: DataFrame, *, by_day: bool = False) -> DataFrame:
    """(segment, timestamp_micros, camera, image, boxes, source_id) of image and box rows with the same three keys.

    ``images`` (keys, image), ``boxes`` (keys, type, cx, cy, w, h). ``source_id`` names all keys, as a segment has many frames.
    """
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WAYMO_TYPES.items() for x in kv]), F.col("type")), F.lit("undefined"))
    corners = F.struct(label.alias("label"), (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    per = boxes.groupBy(*KEYS).agg(F.array_sort(F.collect_list(corners)).alias("boxes"))
    one = images.groupBy(*KEYS).agg(F.min("image").alias("image"))
    out = one.join(per, KEYS).withColumn("source_id", F.concat_ws("_", *[F.col(k).cast("string") for k in KEYS]))
    hour = F.hour(F.timestamp_micros(F.col("timestamp_micros")))
    return out.where((hour >= WORKING_HOURS[0]) & (hour < WORKING_HOURS[1])) if by_day else out


def read_waymo(spark: SparkSession, path: str, boxes_path: str, by_day: bool = False) -> DataFrame:
    """``waymo`` of the image files of ``path`` and the box files of ``boxes_path``."""
    c = lambda name: F.col(f"`{name}`")
    keys = [c("key.segment_context_name").alias("segment"), c("key.frame_timestamp_micros").alias("timestamp_micros"), c("key.camera_name").alias("camera")]
    box = "[CameraBoxComponent]"
    images = spark.read.parquet(path).select(*keys, c("[CameraImageComponent].image").alias("image"))
    rows = spark.read.parquet(boxes_path).select(*keys, c(f"{box}.type").alias("type"), c(f"{box}.box.center.x").alias("cx"), c(f"{box}.box.center.y").alias("cy"), c(f"{box}.box.size.x").alias("w"), c(f"{box}.box.size.y").alias("h"))
    return waymo(images, rows, by_day=by_day)


def waymo_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(keys, image, masks): images with their panoptic labels (keys, panoptic, instances), as far as there are any."""
    per = masks.where("panoptic is not null").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("panoptic", "instances"))).alias("masks"))
    return images.groupBy(*KEYS).agg(F.min("image").alias("image")).join(per, KEYS)


def rle_masks(rows: DataFrame) -> DataFrame:
    """(name, instance_id, category, size, counts) of label rows (name, labels with category and rle): a mask per label with a run-length code, numbered by its place."""
    flat = rows.select("name", F.posexplode("labels").alias("instance_id", "l"))
    return flat.where("l.rle is not null").select("name", "instance_id", "l.category", "l.rle.size", "l.rle.counts")


def rle_area(counts: Column) -> Column:
    """Set pixels of an uncompressed run-length code: runs of zeros and ones by turns, zeros first."""
    ones = F.filter(counts, lambda x, i: i % 2 == 1)
    return F.aggregate(ones, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def sorted_images(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, path, content) of the images below a folder in the order of their paths, ``name`` relative to it; none is an error.

    Suffixes may be in any case.
    """
    from quillon.operators.ordered import dense_position

    files = image_folder(spark, path)
    if files.isEmpty():
        raise ValueError(f"no images below {path}")
    root = re.sub(r"^[a-z0-9]+:/*|/+$", "", path)
    return dense_position(files.select("path", "content"), ["path"], "position").withColumn("name", F.substring_index("path", f"{root}/", -1))


def qa_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The QA rows of the parquet files of a split (``split*.parquet``); none is an error."""
    from quillon.sources.formats import qa_parquet

    return qa_parquet(spark, f"{folder}/{split}*.parquet")


def qa_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "evaluation", "test")) -> dict[str, DataFrame]:
    """The splits of a dataset by name."""
    return {s: qa_split(spark, folder, s) for s in splits}


def store_tables(spark: SparkSession, path: str) -> list[str]:
    """The question types of a key/value store partitioned by question_type."""
    return sorted(r.question_type for r in spark.read.parquet(path).select("question_type").distinct().collect())  # one row per type


def parse_splits(text: str, known: tuple[str, ...] = ("train", "val", "test")) -> list[str]:
    """The splits of 'a+b' or 'a,b', each once; unknown or missing ones are an error."""
    parts = [p.strip() for p in text.replace("+", ",").split(",") if p.strip()]
    wrong = [p for p in parts if p not in known]
    if wrong or not parts:
        raise ValueError(f"unknown splits {wrong} in {text!r}; known: {', '.join(known)}")
    return list(dict.fromkeys(parts))


def file_split(dataset: str, split: str) -> str:
    """The name that a dataset's files have for a split."""
    return {"val": "validation"}.get(split, f"{split}ing") if dataset == "waymo" else split


@dataclass(frozen=True)
class Config:
    """What a generation of QA rows is asked for."""

    dataset_name: str
    split: str = "train"
    models: list[dict] = field(default_factory=list)
    use_wbf: bool = False
    allowable_set: list[str] = field(default_factory=list)
    confidence_threshold: float = 0.2
    batch_size: int = 1
    num_workers: int = 4
    num_samples: int | None = None
    questions: list[dict] = field(default_factory=list)
    transforms: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must be between 0 and 1")
        if self.batch_size < 1 or self.num_workers < 0 or (self.num_samples is not None and self.num_samples < 0):
            raise ValueError("batch_size, num_workers and num_samples must not be negative")
        ok, message = validate_labels(self.allowable_set or [])
        if not ok:
            raise ValueError(message)
        if self.use_wbf and len(self.models) < 2:
            raise ValueError("fusion needs two models at least")


def config_of(values: dict, **overrides: object) -> Config:
    """A configuration from a dict; overrides that are None change nothing, unknown keys are left out with a warning."""
    known = {f.name for f in fields(Config)}
    given = values | {k: v for k, v in overrides.items() if v is not None}
    for k in sorted(given.keys() - known):
        LOG.warning("setting %r is not known", k)
    if "dataset_name" not in given:
        raise ValueError("dataset_name is missing")
    return Config(**{k: v for k, v in given.items() if k in known and v is not None})


def config_from_file(path: str, **overrides: object) -> Config:
    with open(path, encoding="utf-8") as f:
        return config_of(json.load(f), **overrides)


for _name, _reader in (("waymo", read_waymo), ("sorted_images", sorted_images), ("qa_split", qa_split)):
    register(_name, _reader)
