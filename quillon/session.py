"""Session helpers: a local session for tests and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session on this machine, for tests and benchmarks only."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one is set where none is, on a local master only."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = "file://" + tempfile.mkdtemp(prefix="quillon-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it with its lineage cut.

    A checkpointed DataFrame still carries the constraints of the plan it came from, and these grow
    without bound in loops; so the rows are taken up again as a plan without a past. The files go
    when the result is no longer referenced, if the session cleans checkpoints.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().toRdd()
    plain = df.sparkSession._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False)
    return DataFrame(plain, df.sparkSession)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over enough partitions for costly work in Python; a scan of many partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(3 * cores, key)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than ``rows`` + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def path_of(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
