"""Readers of image folders, label JSON and QA stores, and a registry of them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label categories that drop an image.
DROPPED_CATEGORIES = ["other person", "other vehicle", "trail", "trailer"]
_READERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    _READERS[name] = reader


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Reads ``path`` with the reader registered as ``name``; unknown names are an error that lists the known ones."""
    if name not in _READERS:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(_READERS))}")
    return _READERS[name](spark, path, **options)


def any_case(suffixes: tuple[str, ...]) -> str:
    """A glob of files with one of the suffixes, in any case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in s) for s in suffixes) + "}"


def image_folder(spark: SparkSession, path: str, pattern: str = any_case(("jpg", "jpeg", "png", "bmp", "webp"))) -> DataFrame:
    """(path, name, modified, length, content) of the images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")


LABELS = "name string, timestamp bigint, attributes struct<timeofday:string,weather:string>, labels array<struct<category:string,box2d:struct<x1:double,y1:double,x2:double,y2:double>>>"


def label_json(spark: SparkSession, path: str, by_day: bool = False) -> DataFrame:
    """Label files as (name, timestamp, attributes, labels); images without labels or with a dropped category are left out."""
    rows = spark.read.schema(LABELS).json(path, multiLine=True)
    kept = rows.where(F.col("labels").isNotNull() & ~F.exists("labels", lambda x: x["category"].isin(*DROPPED_CATEGORIES)))
    return kept.where(fair_day(F.col("attributes.timeofday"), F.col("attributes.weather"))) if by_day else kept


def fair_day(timeofday: Column, weather: Column) -> Column:
    return (timeofday == "daytime") & ~F.coalesce(weather, F.lit("")).isin("foggy", "snowy", "rainy")


def flat_labels(rows: DataFrame) -> DataFrame:
    """One row per box of ``label_json``: (name, det_idx, label, x1, y1, x2, y2)."""
    return rows.select("name", F.posexplode("labels").alias("det_idx", "l")).select("name", "det_idx", F.col("l.category").alias("label"), "l.box2d.*")


def qa_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The columns that evaluation reads, nested pruning down to image.bytes."""
    return spark.read.parquet(path).select(F.col("image.bytes").alias("image_bytes"), "question", F.col("answer").cast("string").alias("answer"), "question_type", "source_id", F.col("id").cast("bigint").alias("id"))


def qa_store(spark: SparkSession, path: str) -> DataFrame:
    """A key/value QA store written as parquet (question_type, key, value JSON) as (question_type, key, split, question, answer)."""
    kind = "struct<qa_list:array<array<string>>,split:string>"
    rows = spark.read.parquet(path).select("question_type", "key", F.from_json("value", kind).alias("v"))
    return rows.select("question_type", "key", "v.split", F.explode("v.qa_list").alias("p")).select("question_type", "key", "split", F.get("p", F.lit(0)).alias("question"), F.get("p", F.lit(1)).alias("answer"))


for _name, _reader in (("image_folder", image_folder), ("label_json", label_json), ("qa_parquet", qa_parquet), ("qa_store", qa_store)):
    register(_name, _reader)
