"""A series read at many delays before each row of another: one pass along time, whatever the number of delays."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.missing import present
from tracklane.operators.align import SHARD_S
from tracklane.operators.joins import join_checked
from tracklane.session import cut


def _read(pdf: pd.DataFrame, keys: list[str], columns: list[str], keep: list[str], delays: np.ndarray) -> pd.DataFrame:
    """Of one shard the rows of the left series, with an array per column of the right one: its line at each delay before the row, NaN beyond its ends."""
    right = pdf[pdf["_side"] == 0].drop_duplicates("_t").sort_values("_t")
    left = pdf[pdf["_side"] == 1]
    t = right["_t"].to_numpy(float)
    at = left["_t"].to_numpy(float)[:, None] - delays
    out = left[[*keys, *keep]].copy()
    for c in columns:
        v = np.full(at.shape, np.nan) if not len(t) else np.interp(at, t, right[c].to_numpy(float), left=np.nan, right=np.nan)
        out[c] = pd.Series(v.tolist(), index=out.index, dtype=object)
    return out


def at_delays(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], delays: list[float], shard: float = SHARD_S) -> DataFrame:
    """``left`` (keys, time and numbers) with ``delay`` and the ``columns`` of the right series interpolated at time - delay (suffix _at), a row per delay; those beyond the series are left out.

    Series are sharded by time. A shard also holds the right rows within the reach of
    the delays, and the last before and first after those, carried over by a scan with
    one row per shard. Right rows have one row per key and time. Rows without key or
    time meet nothing.
    """
    reach, keep = max(abs(d) for d in delays), [c for c in left.columns if c not in [*keys, time]]
    cell = lambda t: F.floor(t / shard)
    row = F.struct(F.col(time).alias("t"), *columns)
    r = right.filter(F.col(time).isNotNull()).select(*keys, row.alias("r"))
    l = left.filter(F.col(time).isNotNull()).select(*keys, cell(F.col(time)).alias("_shard"), F.col(time).alias("_t"), *keep).withColumn("_side", F.lit(1))
    near = F.array_distinct(F.array(cell(F.col("r.t") - reach), cell(F.col("r.t")), cell(F.col("r.t") + reach)))
    inside = r.withColumn("_shard", F.explode(near))
    edge = r.withColumn("_shard", cell(F.col("r.t")))
    start, end = F.col("_shard") * shard, (F.col("_shard") + 1) * shard
    edge = edge.groupBy(*keys, "_shard").agg(
        F.min("r").alias("first"), F.max("r").alias("last"), F.min(F.when(F.col("r.t") >= start + reach, F.col("r"))).alias("first_clear"), F.max(F.when(F.col("r.t") <= end - reach, F.col("r"))).alias("last_clear")
    )
    edge = edge.unionByName(l.select(*keys, "_shard").distinct(), allowMissingColumns=True)
    edge = edge.groupBy(*keys, "_shard").agg(*(F.max(c).alias(c) for c in ("first", "last", "first_clear", "last_clear")))
    w = Window.partitionBy(*keys).orderBy("_shard")
    v = Window.partitionBy(*keys).orderBy(F.desc("_shard"))
    beside = lambda win, whole, clear, step: F.when(
        F.lag("_shard").over(win) == F.col("_shard") + step, F.coalesce(F.lag(clear).over(win), F.last(whole, ignorenulls=True).over(win.rowsBetween(Window.unboundedPreceding, -2)))
    ).otherwise(F.last(whole, ignorenulls=True).over(win.rowsBetween(Window.unboundedPreceding, -1)))
    ends = edge.select(*keys, "_shard", beside(w, "last", "last_clear", -1).alias("a"), beside(v, "first", "first_clear", 1).alias("b"))
    ends = ends.select(*keys, "_shard", F.explode(F.array_compact(F.array("a", "b"))).alias("r"))
    right_rows = inside.unionByName(ends).select(*keys, "_shard", F.col("r.t").alias("_t"), *(F.col(f"r.{c}").cast("double").alias(c) for c in columns), F.lit(0).alias("_side"))
    both = right_rows.unionByName(l, allowMissingColumns=True)
    types = dict(left.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *keep]) + "".join(f", `{c}` array<double>" for c in columns)
    read = both.groupBy(*keys, "_shard").applyInPandas(_plain(partial(_read, keys=keys, columns=columns, keep=keep, delays=np.array(delays, float))), schema)
    zipped = F.arrays_zip(F.array(*(F.lit(float(d)) for d in delays)).alias("delay"), *columns)
    out = read.select(*keys, *keep, F.explode(zipped).alias("z")).select(*keys, *keep, F.col("z.delay").alias("delay"), *(F.col(f"z.{c}").alias(f"{c}_at") for c in columns))
    return out.filter(present(F.col(f"{columns[0]}_at")))


def _plain(fn: partial) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf)

    return read


ACCURACY = 10_000


def middle(x: str | Column, p: float = 0.5) -> Column:
    """The value of rank ceil(p n): exact in groups of up to ACCURACY rows, beyond that off by n / ACCURACY ranks at most; combined before the shuffle."""
    return F.percentile_approx(x, p, ACCURACY)


def judged_delay(score: DataFrame, keys: list[str], more: str, edge: float, flat: float, few: int) -> DataFrame:
    """The delay of the least score per key, first of equals, from a grid of -edge to edge by 0.02 s; in doubt at the grid's edge, of few rows, or where the scores hardly differ.

    ``score``: keys, delay, n, score and a further figure ``more``; a row per delay, so few per key.
    """
    best = score.groupBy(*keys).agg(F.min(F.struct(F.round("score", 6).alias("score"), "delay", "n", F.round(more, 6).alias(more))).alias("b"), (F.percentile("score", 0.9) - F.min("score")).alias("span"))
    doubt = F.concat_ws("+", F.when(F.abs("b.delay") > edge - 0.03, "edge"), F.when(F.col("b.n") < few, "few"), F.when(F.col("span") < flat, "flat"))
    return best.select(*keys, "b.score", F.col("b.delay").alias("tau"), "b.n", f"b.{more}", F.round("span", 5).alias("span"), doubt.alias("doubt"))


CENTRES = 1_000_000  # rows of a few numbers that are broadcast at most: some 40 MB


def residual_scores(rows: DataFrame, keys: list[str], centre: Callable[[], list[Column]], residual: Column, scores: dict[str, Column]) -> DataFrame:
    """Per key and delay n and ``scores`` of ``residual``, which may use the columns that ``centre`` aggregates per key and delay."""
    per = [*keys, "delay"]
    middle_of = cut(rows.groupBy(*per).agg(*centre()))  # a row per key and delay
    d = join_checked(rows, middle_of, per, max_rows=CENTRES).withColumn("res", residual)
    return d.groupBy(*per).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in scores.items())).filter("n >= 5")
