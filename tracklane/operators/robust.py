"""Statistics that outliers do not move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.operators.frames import exact_percentiles
from tracklane.operators.joins import join_checked
from tracklane.session import cut


def robust_sigma(df: DataFrame, keys: list[str], value: str, least: int = 10) -> DataFrame:
    """(keys..., n, mid, mad, sigma): median, median deviation, and 1.4826 times it, or the population deviation where it is 0; null under ``least`` rows."""
    mid = cut(exact_percentiles(df, keys, value, {"mid": 0.5}).drop("n"))
    d = join_checked(df.select(*keys, value), mid, keys).withColumn("_d", F.abs(F.col(value) - F.col("mid")))
    mad = exact_percentiles(d, keys, "_d", {"mad": 0.5})
    sd = df.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    out = mad.join(mid, keys).join(sd, keys)
    sigma = F.when(F.col("n") >= least, F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("_sd")))
    return out.select(*keys, "n", "mid", "mad", sigma.alias("sigma"))


def robust_vector_mean(df: DataFrame, keys: list[str], parts: list[str], trim: float = 3.5) -> DataFrame:
    """(keys..., n, kept, parts...): mean of vectors without those far from the componentwise median.

    Far is beyond the median distance plus ``trim`` robust sigmas of it; nothing is
    trimmed in groups of fewer than five, without spread, or if fewer than two or a
    third would stay. Groups are small (a time bin of a sensor): medians are kept in
    one aggregate each.
    """
    ok = df.select(*keys, *parts)
    mid = ok.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile(p, 0.5).alias(f"_m{i}") for i, p in enumerate(parts)))
    d = ok.join(mid, keys)
    far = F.sqrt(sum(((F.col(p) - F.col(f"_m{i}")) ** 2 for i, p in enumerate(parts)), F.lit(0.0)))
    d = d.withColumn("_r", far)
    spread = d.groupBy(*keys).agg(F.percentile("_r", 0.5).alias("_rm"))
    d = d.join(spread, keys)
    sigma = d.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col("_r") - F.col("_rm")), 0.5)).alias("_rs"))
    d = d.join(sigma, keys).withColumn("_near", F.col("_r") <= F.col("_rm") + trim * F.col("_rs"))
    all_ = [F.avg(p).alias(f"_a{i}") for i, p in enumerate(parts)]
    some = [F.avg(F.when(F.col("_near"), F.col(p))).alias(f"_b{i}") for i, p in enumerate(parts)]
    g = d.groupBy(*keys, "n", "_rs").agg(F.count_if("_near").alias("_k"), *all_, *some)
    does = (F.col("n") >= 5) & (F.col("_rs") > 1e-6) & (F.col("_k") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    return g.select(*keys, "n", F.when(does, F.col("_k")).otherwise(F.col("n")).alias("kept"), *(F.when(does, F.col(f"_b{i}")).otherwise(F.col(f"_a{i}")).alias(p) for i, p in enumerate(parts)))
