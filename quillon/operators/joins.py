"""Joins of large tables with tables that are usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import small_enough

#: Rows up to which the small side of ``bounded_join`` is broadcast.
MOST_BROADCAST = 100_000
SALTS = 16


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", *, most: int = MOST_BROADCAST, salts: int = SALTS) -> DataFrame:
    """``big`` joined to ``small`` on few, hot keys: broadcast if ``small`` has at most ``most`` rows, else salted.

    The size of ``small`` is checked, so it should be cheap to compute or cut. With salts each row of
    ``small`` is repeated ``salts`` times and a key of ``big`` is spread over as many tasks. ``how`` is
    inner, left, left_semi or left_anti.
    """
    if small_enough(small, most):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
