"""Order-dependent building blocks that never bring one whole group into one task.

``hash_running`` ranks and sums the rows of a group in the order of a hash of their key. The hash
range is cut into buckets; each bucket is ranked by itself and shifted by the totals of the buckets
before it, so that a group holding a third of all rows is worked on by many tasks.

``dense_position`` numbers all rows in a given order by a range sort and the row counts of the
sorted partitions (a table of one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut, shuffle_width

HASH_BITS = 32
#: Buckets of a group: a group of 10 thousand million rows has some 2.4 million in each.
BUCKETS = 4096


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A hash of ``cols`` in 0 .. 2**32 - 1; nulls take part as a value of their own."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << HASH_BITS))


def hash_running(
    df: DataFrame,
    group: list[str],
    key: list[str],
    value: str | None = None,
    *,
    seed: int = 0,
    buckets: int = BUCKETS,
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Adds ``rank`` (from 1) and, given ``value``, the inclusive running sum ``total`` of each
    group in the order of the hash of ``key``, ties by ``key`` itself.

    Rows must be unique in ``group`` + ``key`` for the order to be total. Null groups form one
    group. A null ``value`` counts as 0.
    """
    h, b = "_hash", "_bucket"
    work = df.withColumn(h, unit_hash(*key, seed=seed)).withColumn(b, F.floor(F.col(h) * buckets / (1 << HASH_BITS)).cast("int"))
    sums = [F.count(F.lit(1)).alias("_n")]
    amount = F.coalesce(F.col(value), F.lit(0)) if value else None
    if value:
        sums.append(F.sum(amount).alias("_s"))
    per = work.groupBy(*group, b).agg(*sums)
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *[F.col(g).alias(f"_o_{g}") for g in group],
        F.col(b).alias("_o_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0")] if value else []),
    )
    within = Window.partitionBy(*group, b).orderBy(h, *key)
    inner = work.withColumn("_r", F.row_number().over(within))
    if value:
        inner = inner.withColumn("_t", F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col(b) == F.col("_o_bucket")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    out = inner.join(offsets, on).withColumn(rank, F.col("_r") + F.col("_n0"))
    if value:
        out = out.withColumn(total or "total", F.col("_t") + F.col("_s0"))
    drop = [h, b, "_r", "_n0", "_o_bucket", *[f"_o_{g}" for g in group]] + (["_t", "_s0"] if value else [])
    return out.drop(*drop)


def dense_position(df: DataFrame, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Adds ``name``, the position from 0 of each row in the order of the columns ``order``.

    The rows are range-partitioned and sorted once; the result is checkpointed in that order, so
    that positions stay the same when a task is run again. Ties get any of their positions.
    """
    n = partitions or shuffle_width(df.sparkSession)
    sorted_rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    counts = sorted_rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))  # one row per partition
    low = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.join(starts, "_pid").withColumn(name, F.col("_start") + low).drop("_pid", "_seq", "_start")


def ordered_running(df: DataFrame, group: list[str], order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds ``name``, the inclusive running sum of ``value`` over the rows of each group in the order of the columns ``order``.

    Rows are range-partitioned by group and order, summed within each partition and shifted by the
    sums of the partitions before. ``order`` must be total within a group and groups not null.
    """
    n = partitions or shuffle_width(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_pid").agg(F.sum(value).alias("_s"))
    offsets = sums.select(*group, "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    within = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(offsets, [*group, "_pid"]).withColumn(name, F.col(name) + F.coalesce("_s0", F.lit(0))).drop("_pid", "_s0")
