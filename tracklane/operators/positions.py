"""Row positions along a source without sorting a source in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, source: list[str], order: list[str], bucket: Column, out: str = "pos") -> DataFrame:
    """Zero-based position of each row within its source by ``order``.

    ``bucket`` is a coarsened first order column (it must not decrease with the
    order). Rows are numbered inside their bucket; where a bucket starts comes from a
    running sum over the bucket counts, one row per bucket.
    """
    rows = df.withColumn("_b", bucket)
    inside = Window.partitionBy(*source, "_b").orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(inside))
    ks = [f"_c{i}" for i in range(len(source) + 1)]
    counts = df.select(*(F.col(s).alias(k) for s, k in zip(source, ks[:-1], strict=True)), bucket.alias(ks[-1])).groupBy(*ks).count()
    upto = Window.partitionBy(*ks[:-1]).orderBy(ks[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count")
    on = [F.col(s).eqNullSafe(F.col(k)) for s, k in zip([*source, "_b"], ks, strict=True)]
    return rows.join(counts, on).withColumn(out, F.col("_start") + F.col("_in") - 1).drop("_b", "_in", "_start", *ks)
