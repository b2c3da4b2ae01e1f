"""Windows over long series: frames of rows, running sums and exact percentiles without a series in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.operators.joins import join_checked
from tracklane.operators.positions import with_positions
from tracklane.session import cut

BLOCK = 8192


def in_blocks(df: DataFrame, keys: list[str], order: list[str], bucket: Column, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Rows with pos, _block and _own: each block also holds the ``before`` and ``after`` rows around it (not _own)."""
    placed = with_positions(df, keys, order, bucket)
    home = F.floor(F.col("pos") / block).cast("bigint")
    at = F.col("pos") - home * block
    blocks = F.array(home, F.when((at < after) & (home > 0), home - 1), F.when(at >= block - before, home + 1))
    return placed.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(blocks))).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home")


def block_window(keys: list[str]):
    return Window.partitionBy(*keys, "_block").orderBy("pos")


def owned(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block")


def with_rolling_mad(df: DataFrame, x: str, w, out: str) -> DataFrame:
    """Median absolute deviation of ``x`` within a frame, as column ``out``."""
    d = df.withColumn("_vs", F.collect_list(x).over(w)).withColumn("_vs", F.array_sort("_vs")).withColumn("_mid", _mid(F.col("_vs")))
    d = d.withColumn("_vs", F.transform("_vs", lambda v: F.abs(v - F.col("_mid"))))
    return d.withColumn(out, _mid(F.array_sort("_vs"))).drop("_vs", "_mid")


def _mid(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def slope(y, t, w):
    """Second-order derivative estimate for uneven steps, one-sided at the ends."""
    h0, h1 = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    y0, y1 = F.lag(y).over(w), F.lead(y).over(w)
    mid = (h0 * h0 * y1 + (h1 * h1 - h0 * h0) * F.col(y) - h1 * h1 * y0) / (h0 * h1 * (h0 + h1))
    return F.when(y0.isNull(), (y1 - F.col(y)) / h1).when(y1.isNull(), (F.col(y) - y0) / h0).otherwise(mid)


def last_known(df: DataFrame, keys: list[str], order: list[str], what: Column, name: str, shard: float = 600.0) -> DataFrame:
    """``df`` with the last value of ``what`` that is not null up to and with each row; shards of the first order column are joined by a scan with one row per shard."""
    d = df.withColumn("_shard", F.floor(F.col(order[0]) / shard)).withColumn("_what", what)
    w = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(*keys, "_shard").agg(F.max(F.when(F.col("_what").isNotNull(), F.struct(*order, "_what"))).alias("_end"))
    ks = [f"_e{i}" for i in range(len(keys))]
    scan = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(e) for k, e in zip(keys, ks, strict=True)), F.col("_shard").alias("_es"), F.last("_end", ignorenulls=True).over(scan)["_what"].alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(e)) for k, e in zip(keys, ks, strict=True)] + [F.col("_shard").eqNullSafe(F.col("_es"))]
    d = d.withColumn("_here", F.last("_what", ignorenulls=True).over(w)).join(ends, on)
    return d.select(*df.columns, F.coalesce("_here", "_before").alias(name))


def running_sum(df: DataFrame, keys: list[str], values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Sums of ``values`` (name to column) up to and with each row by ``pos``; block sums are carried by a scan over blocks."""
    names = list(values)
    d = df.withColumn("_block", F.floor(F.col("pos") / block)).withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    w = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = d.groupBy(*keys, "_block").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))))
    scan = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ks = [f"_e{i}" for i in range(len(keys))]
    carry = sums.select(
        *(F.col(k).alias(e) for k, e in zip(keys, ks, strict=True)), F.col("_block").alias("_eb"), *(F.coalesce(F.sum(f"_s{i}").over(scan), F.lit(0)).alias(f"_c{i}") for i in range(len(names)))
    )
    on = [F.col(k).eqNullSafe(F.col(e)) for k, e in zip(keys, ks, strict=True)] + [F.col("_block") == F.col("_eb")]
    out = d.withColumns({f"_r{i}": F.sum(f"_v{i}").over(w) for i in range(len(names))}).join(carry, on)
    return out.select(*df.columns, *((F.coalesce(F.col(f"_r{i}"), F.lit(0)) + F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)))


BAND = 0.002  # of the ranks on either side of a percentile, four times the error of the first pass


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys..., n, a column per prob): linear percentiles of the values that are not null.

    A first pass sketches each group (combined before the shuffle) and gives a band of
    values around each percentile. The second keeps apart only values inside a band and
    counts the others between bands, so of a large group a few rows in a thousand are
    shuffled, and equal values as one row. Should a rank fall outside its band the query
    fails; it is never answered by a guess.
    """
    ks = [f"_key{i}" for i in range(len(keys))]
    d = df.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), (F.col(value).cast("double") + 0.0).alias("v"))
    cuts = sorted({min(max(p + x, 0.0), 1.0) for p in probs.values() for x in (-BAND, BAND)})
    sketch = d.groupBy(*ks).agg(F.percentile_approx("v", [float(c) for c in cuts], int(4 / BAND)).alias("_cuts"), F.count("*").alias("_n"))
    d = join_checked(d, cut(sketch), ks, "inner")
    low = {p: F.col("_cuts")[cuts.index(max(p - BAND, 0.0))] for p in probs.values()}
    high = {p: F.col("_cuts")[cuts.index(min(p + BAND, 1.0))] for p in probs.values()}
    inside = F.col("_n") * BAND < 2  # groups so small are kept whole, as neighbouring ranks count too
    for p in probs.values():
        # the first and last percents reach to the ends, whatever the sketch says
        inside = inside | ((F.lit(p <= BAND) | (F.col("v") >= low[p])) & (F.lit(p >= 1 - BAND) | (F.col("v") <= high[p])))
    region = F.size(F.filter("_cuts", lambda c: c <= F.col("v")))
    region = F.when(inside, region * 2).otherwise(region * 2 + 1)  # of one number of cuts, those in a band come first or are alone
    counts = d.groupBy(*ks, region.alias("_g"), F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"), F.min("v").alias("_least"))
    w = Window.partitionBy(*ks)
    upto = F.sum("c").over(w.orderBy("_least").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"hi": upto, "n": F.sum("c").over(w)}).withColumn("lo", F.col("hi") - F.col("c"))
    aggs, out = [], [F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)] + [F.col("n")]
    for i, (name, p) in enumerate(probs.items()):
        at = (F.col("n") - 1) * F.lit(float(p))
        for j, r in (("a", F.floor(at)), ("b", F.ceil(at))):
            here = (F.col("lo") <= r) & (r < F.col("hi"))
            found = F.when(F.col("v").isNull(), F.raise_error(F.lit(f"the rank of {name} lies outside its band"))).otherwise(F.col("v"))
            aggs.append(F.max(F.when(here, found)).alias(f"p{i}{j}"))
        out.append((F.col(f"p{i}a") + (F.col(f"p{i}b") - F.col(f"p{i}a")) * (at - F.floor(at))).alias(name))
    return ranked.groupBy(*ks).agg(F.max("n").alias("n"), *aggs).select(*out)
