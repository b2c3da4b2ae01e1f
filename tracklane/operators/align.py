"""Joins along time: the neighbours of a time in another series, and what follows from them.

Series are sharded by stretches of time; windows stay inside a shard, and what a
shard needs from beyond is its neighbours' first and last row, carried over by a
scan over one row per shard. So a series of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_S = 600.0


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], shard: float = SHARD_S) -> DataFrame:
    """``left`` with prev and next: structs (time, carry...) of the last right row at or before, and the first after, its time.

    Right rows have one row per key and time; rows of either side without key or time
    meet nothing. A left row without a neighbour on a side has null there.
    """
    lcols = [c for c in left.columns if c not in keys]
    r_type = F.struct(F.col(time), *carry)
    r = right.filter(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), r_type.alias("_r"))
    l = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    both = r.unionByName(l, allowMissingColumns=True).withColumn("_shard", F.floor(F.col("_t") / shard))
    # both ways as frames that only ever grow: one pass each
    forth = Window.partitionBy(*keys, "_shard").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "_shard").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_prev": F.last("_r", ignorenulls=True).over(forth), "_next": F.last("_r", ignorenulls=True).over(back)}).filter(F.col("_side") == 1)
    edges = both.groupBy(*keys, "_shard").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    scan = Window.partitionBy(*keys).orderBy("_shard")
    edges = edges.select(
        *(F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)),
        F.col("_shard").alias("_es"),
        F.last("_last", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(scan.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    on = [F.col(k) == F.col(f"_e{i}") for i, k in enumerate(keys)] + [F.col("_shard") == F.col("_es")]
    out = seen.join(edges, on, "left")
    return out.select(
        *keys, *(F.col("_l")[c].alias(c) for c in lcols), F.coalesce("_prev", "_before").alias("prev"), F.coalesce("_next", "_after").alias("next")
    )


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], tolerance: float | None = None, shard: float = SHARD_S) -> DataFrame:
    """``left`` with ``carry`` of the last right row at or before its time and ``age`` (null without one, or older than ``tolerance``)."""
    out = neighbours(left, right, keys, time, carry, shard)
    age = F.col(time) - F.col("prev")[time]
    near = F.lit(True) if tolerance is None else age <= tolerance
    return out.select(*left.columns, *(F.when(near, F.col("prev")[c]).alias(c) for c in carry), F.when(near, age).alias("age"))


def line_at(time: str, column: str, clamp: bool = False) -> Column:
    """Linear interpolation between prev and next; beyond the ends null, or with ``clamp`` the end's value."""
    p, q = F.col("prev"), F.col("next")
    w = (F.col(time) - p[time]) / (q[time] - p[time])
    inside = p[column] + (q[column] - p[column]) * w
    at_end = p[column] if clamp else F.when(p[time] == F.col(time), p[column])
    before = q[column] if clamp else F.lit(None).cast("double")
    return F.when(p.isNull(), before).when(q.isNull(), at_end).otherwise(inside)


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], clamp: bool = False, shard: float = SHARD_S) -> DataFrame:
    """``left`` with ``columns`` of the right series interpolated at its times (suffix _at)."""
    out = neighbours(left, right, keys, time, columns, shard)
    return out.select(*left.columns, *(line_at(time, c, clamp).alias(f"{c}_at") for c in columns))
