"""Models as functions over Arrow batches: detectors, segmenters, depth and language models, made once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.streaming.replay import cached

BOXES = "image_id bigint, det_idx int, cls int, label string, score double, x1 double, y1 double, x2 double, y2 double"
MASKS = "image_id bigint, det_idx int, mask binary"
DEPTHS = "image_id bigint, depth binary"
_MADE: dict[str, Any] = {}


def _model(name: str, make: Callable[[], Any]) -> Any:
    """The model of a name in this worker."""
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def applied(rows: DataFrame, name: str, make: Callable[[], Callable[[pd.DataFrame], list[tuple]]], schema: str, batch: int = 64) -> DataFrame:
    """``schema`` rows that a model gives for batches of ``rows``; ``make`` loads it, once in each worker."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(name, make)
        for part in parts:
            out = [r for at in range(0, len(part), batch) for r in model(part.iloc[at : at + batch])]
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, schema)


def detected(images: DataFrame, name: str, make: Callable[[], Callable[[pd.DataFrame], list[tuple]]]) -> DataFrame:
    """``BOXES`` of images (image_id, content)."""
    return applied(images.select("image_id", "content"), name, make, BOXES)


def segmented(images: DataFrame, det: DataFrame, name: str, make: Callable[[], Callable[[pd.DataFrame], list[tuple]]]) -> DataFrame:
    """``MASKS`` of the boxes of images, a null mask where there is none."""
    rows = det.select("image_id", "det_idx", "x1", "y1", "x2", "y2").join(images.select("image_id", "content"), "image_id")
    return applied(rows, name, make, MASKS)


def depths_of(images: DataFrame, name: str, make: Callable[[], Callable[[pd.DataFrame], list[tuple]]]) -> DataFrame:
    """``DEPTHS`` of images: little-endian floats, a number per pixel."""
    return applied(images.select("image_id", "content"), name, make, DEPTHS)


def answered(prompts: DataFrame, name: str, make: Callable[[], Callable[[pd.DataFrame], list[tuple]]], cache: DataFrame | None = None) -> DataFrame:
    """(id, answer) of prompts (id, prompt); answers of a cache (model, prompt, answer) are not asked for again, and each other prompt only once."""
    key = prompts.select("id", F.lit(name).alias("model"), "prompt")
    empty = prompts.sparkSession.createDataFrame([], "model string, prompt string, answer string")
    known, todo = cached(key, empty if cache is None else cache, ["model", "prompt"])
    fresh = applied(todo.select("prompt"), name, make, "prompt string, answer string")
    return known.drop("answer").join((empty if cache is None else cache).where(F.col("model") == name).select("prompt", "answer").unionByName(fresh).groupBy("prompt").agg(F.min("answer").alias("answer")), "prompt", "left").select("id", "answer")
