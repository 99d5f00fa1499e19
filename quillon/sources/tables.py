"""Readers of the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.session import path_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``; columns and filters are pruned into the scan by Catalyst."""
    return spark.read.parquet(path_of(sf_dir, name))
