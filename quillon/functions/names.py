"""One spelling for the names that tables write in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each written split means, in lower case without blanks around it.
SPLIT_NAMES = {
    "train": "train",
    "training": "train",
    "eval": "evaluation",
    "evaluation": "evaluation",
    "val": "evaluation",
    "valid": "evaluation",
    "validation": "evaluation",
    "dev": "evaluation",
    "test": "test",
    "testing": "test",
}


def plain_split(split: Column) -> Column:
    """train, evaluation or test; null for null, blank and unknown names."""
    names = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.trim(F.regexp_replace(split, r"\s+", " "))))


def plain_key(name: Column) -> Column:
    """Lower case letters and digits only: one key for camel, snake, hyphen and blank spellings."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]+", ""), F.lit(""))


def file_name(source_id: Column) -> Column:
    """The last part of a path in lower case, with '_' for '-'."""
    base = F.regexp_extract(F.regexp_replace(F.trim(source_id), r"\\", "/"), r"([^/]*)$", 1)
    return F.regexp_replace(F.lower(F.trim(base)), "-", "_")


def bare_name(source_id: Column) -> Column:
    """``file_name`` without its extension."""
    return F.regexp_replace(file_name(source_id), r"\.[a-z0-9]{1,5}$", "")


def stem_name(source_id: Column) -> Column:
    """``bare_name`` up to its number or hexadecimal id: the name of the picture a file was derived from."""
    bare = bare_name(source_id)
    stem = F.regexp_extract(bare, r"^((?:[a-z]+_)+(?:\d+|[0-9a-f]{8,}))(?![0-9a-z])", 1)
    return F.when(stem == "", bare).otherwise(stem)


def scene_name(source_id: Column) -> Column:
    """``stem_name`` without leading zeros of its number; null for null and blank names."""
    stem = stem_name(source_id)
    return F.nullif(F.regexp_replace(stem, r"_0+(\d+)$", "_$1"), F.lit(""))
