"""Joins whose strategy depends on a checked size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 16


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join on null-safe keys; ``small`` holds at most one row per key.

    ``small`` is counted first (it should be materialised): up to ``max_rows`` rows it
    is broadcast, beyond that ``big`` is salted and each row of ``small`` repeated once
    per salt, so that no key of ``big``, however frequent, meets in one task.
    """
    other = small.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    fits = len(small.select(*keys).take(max_rows + 1)) <= max_rows if max_rows < 1000 else small.limit(max_rows + 1).count() <= max_rows
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    drop = [f"_k{i}" for i in range(len(keys))]
    if fits:
        return big.join(F.broadcast(other), reduce(lambda a, b: a & b, on), how).drop(*drop)
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)))
    other = other.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    on.append(F.col("_salt") == F.col("_with"))
    return big.join(other, reduce(lambda a, b: a & b, on), how).drop(*drop, "_salt", "_with")
