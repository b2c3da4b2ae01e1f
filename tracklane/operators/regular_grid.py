"""Irregular readings onto a regular grid (problem 7).

Readings fall into cells of fixed width, cells into time shards. A shard's summary
is its first and last cell with a reading; a prefix scan over the summaries (one row
per shard, not per reading) gives every shard the last value before and the first
value after it. With these carried in, shards are filled independently of each
other, also those that hold no reading at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.missing import finite, present


@dataclass(frozen=True)
class GridConfig:
    cell_s: float = 1.0
    shard_cells: int = 512
    interpolate_up_to: int = 5  # longer gaps are only marked
    any_number: bool = True  # infinite readings are usable too (but never interpolated)


def regular_grid(df: DataFrame, keys: list[str], time: str, value: str, cfg: GridConfig = GridConfig()) -> DataFrame:
    """(keys..., cell, n, value, status, last_cell, next_cell) for all cells from a source's first to its last reading.

    status: 'read' (value is the mean of the cell's readings), 'filled' (linear in
    the gap between its neighbours, up to ``interpolate_up_to`` cells) or 'gap' (null
    value). Readings with a missing (null, NaN) or infinite time, or a missing value,
    are not usable. Null keys form a source of their own; repeated readings weigh
    repeatedly in the mean, as they were recorded; a source without usable readings
    yields no cell.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    usable = finite(F.col(time)) & (present(F.col(value)) if cfg.any_number else finite(F.col(value)))
    cells = (
        df.filter(usable)
        .select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), F.floor(F.col(time) / cfg.cell_s).alias("cell"), F.col(value).cast("double").alias("v"))
        .groupBy(*ks, "cell")
        .agg(F.count("*").alias("n"), F.avg("v").alias("v"))
        .withColumn("shard", F.floor(F.col("cell") / cfg.shard_cells))
    )
    at = F.struct("cell", "v")
    shards = cells.groupBy(*ks, "shard").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    scan = Window.partitionBy(*ks).orderBy("shard")
    carried = shards.select(*ks, "shard", "first", "last").withColumns(
        {"before": F.lag("last").over(scan), "after": F.lead("first").over(scan), "next_shard": F.lead("shard").over(scan)}
    )
    # a shard and the empty ones up to the next; an empty one has the same neighbours throughout
    spans = carried.select(
        *ks,
        "first",
        "last",
        "before",
        "after",
        F.col("shard").alias("own"),
        F.explode(F.sequence("shard", F.coalesce(F.col("next_shard") - 1, F.col("shard")))).alias("shard"),
    )
    empty = F.col("shard") != F.col("own")
    spans = spans.withColumn("before", F.when(empty, F.col("last")).otherwise(F.col("before")))
    low = F.greatest(F.col("shard") * cfg.shard_cells, F.when(F.col("before").isNull(), F.col("first.cell")).otherwise(F.col("shard") * cfg.shard_cells))
    high = F.when(F.col("after").isNull(), F.col("last.cell")).otherwise((F.col("shard") + 1) * cfg.shard_cells - 1)
    grid = spans.select(*ks, "shard", "before", "after", F.explode(F.sequence(low, high)).alias("cell"))
    full = grid.join(cells.select(*(F.col(k).alias(f"r{k}") for k in ks), F.col("cell").alias("rcell"), "n", "v"), [*(F.col(k).eqNullSafe(F.col(f"r{k}")) for k in ks), F.col("cell") == F.col("rcell")], "left")
    back = Window.partitionBy(*ks, "shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy(*ks, "shard").orderBy("cell").rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("n").isNotNull(), F.struct("cell", "v"))
    full = full.withColumn("prev", F.coalesce(F.last(here, ignorenulls=True).over(back), F.col("before")))
    full = full.withColumn("next", F.coalesce(F.first(here, ignorenulls=True).over(fwd), F.col("after")))
    gap = F.col("next.cell") - F.col("prev.cell")
    share = (F.col("cell") - F.col("prev.cell")) / gap
    line = F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * share
    fill = (gap - 1 <= cfg.interpolate_up_to) & finite(F.col("prev.v")) & finite(F.col("next.v"))
    read = F.col("n").isNotNull()
    return full.select(
        *(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)),
        "cell",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(read, F.col("v")).when(fill, line).alias("value"),
        F.when(read, "read").when(fill, "filled").otherwise("gap").alias("status"),
        F.col("prev.cell").alias("last_cell"),
        F.col("next.cell").alias("next_cell"),
    )
