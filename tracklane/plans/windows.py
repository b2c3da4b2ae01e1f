"""Queries over frames of neighbouring rows and over running sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.operators.align import neighbours
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, owned, running_sum, slope, with_rolling_mad
from tracklane.operators.joins import join_checked
from tracklane.operators.positions import with_positions
from tracklane.plans.alignment import KEY, r6, slope_sql
from tracklane.session import cut
from tracklane.sources.sensors import baro, flow, gps, vision, with_sql
from tracklane.sources.tables import table


def _series(df: DataFrame, before: int, after: int) -> DataFrame:
    return in_blocks(df, KEY, ["tr"], F.floor(F.col("tr") / 600), before, after)


def q_rolling_median_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing median of 11 barometer heights, then trailing mean of 11 medians."""
    d = _series(baro(spark, folder).select("flight_id", "sample_id", "tr", "u"), 20, 0)
    w = block_window(KEY).rowsBetween(-10, 0)
    d = d.withColumn("med", F.percentile("u", 0.5).over(w)).withColumn("smooth", F.avg("med").over(w))
    return owned(d).select("flight_id", "sample_id", r6("med"), r6("smooth"))


MEDIAN_MEAN_SQL = with_sql("baro", more="m AS (SELECT *, quantile_cont(u, 0.5) OVER w AS med FROM baro WINDOW w AS (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))") + (
    "SELECT flight_id, sample_id, round(med, 6) AS med, round(avg(med) OVER (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS smooth FROM m"
)


def q_rolling_mad_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Vision vx against its trailing median and median deviation (31 rows, 6 at least): score and gate at 6."""
    d = _series(vision(spark, folder).select("flight_id", "sample_id", "tr", "vx"), 30, 0)
    w = block_window(KEY).rowsBetween(-30, 0)
    d = d.withColumn("n", F.count("vx").over(w)).withColumn("med", F.percentile("vx", 0.5).over(w))
    d = with_rolling_mad(d, "vx", w, "mad")
    enough = F.col("n") >= 6
    d = d.withColumns({"med": F.when(enough, F.col("med")), "mad": F.when(enough, F.col("mad") + 1e-9)})
    d = d.withColumn("score", 0.6745 * F.abs(F.col("vx") - F.col("med")) / F.col("mad"))
    bad = F.coalesce(F.col("score") > 6, F.lit(False))
    return owned(d).select("flight_id", "sample_id", r6("med"), r6("mad"), F.round("score", 4).alias("score"), bad.alias("bad"))


MAD_SQL = with_sql("vision", more="m AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN quantile_cont(vx, 0.5) OVER w END AS med, CASE WHEN count(*) OVER w >= 6 THEN mad(vx) OVER w + 1e-9 END AS mad FROM vision WINDOW w AS (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))") + (
    "SELECT flight_id, sample_id, round(med, 6) AS med, round(mad, 6) AS mad, round(0.6745 * abs(vx - med) / mad, 4) AS score, coalesce(0.6745 * abs(vx - med) / mad > 6, FALSE) AS bad FROM m"
)


def q_centered_median(spark: SparkSession, folder: str) -> DataFrame:
    d = _series(gps(spark, folder).select("flight_id", "fix_id", "tr", "u"), 3, 3)
    d = d.withColumn("med", F.percentile("u", 0.5).over(block_window(KEY).rowsBetween(-3, 3)))
    return owned(d).select("flight_id", "fix_id", r6("med"))


CENTERED_SQL = with_sql("gps") + "SELECT flight_id, fix_id, round(quantile_cont(u, 0.5) OVER (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS med FROM gps"


def q_fill_bf_ff(spark: SparkSession, folder: str) -> DataFrame:
    """Flow with missing values filled from the next reading, and at the end from the last."""
    f = flow(spark, folder).select("flight_id", F.col("frame_idx").cast("double").alias("tr"), F.col("flow_x_px_s_filt").alias("x"))
    d = neighbours(f, f.filter("x IS NOT NULL"), KEY, "tr", ["x"], shard=4096)
    return d.select("flight_id", F.col("tr").cast("bigint").alias("frame_idx"), F.round(F.coalesce("x", "next.x", "prev.x"), 6).alias("filled"))


FILL_SQL = with_sql("flow") + (
    "SELECT flight_id, frame_idx, round(coalesce(first_value(flow_x_px_s_filt IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    "last_value(flow_x_px_s_filt IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS filled FROM flow"
)


def q_gradient(spark: SparkSession, folder: str) -> DataFrame:
    d = _series(gps(spark, folder).select("flight_id", "fix_id", "tr", "e", "n"), 1, 1)
    w = block_window(KEY)
    return owned(d.withColumn("ve", slope("e", "tr", w)).withColumn("vn", slope("n", "tr", w))).select("flight_id", "fix_id", r6("ve"), r6("vn"))


GRADIENT_SQL = with_sql("gps") + f"SELECT flight_id, fix_id, round({slope_sql('e')}, 6) AS ve, round({slope_sql('n')}, 6) AS vn FROM gps WINDOW w AS (PARTITION BY flight_id ORDER BY tr)"


def q_step_speed(spark: SparkSession, folder: str) -> DataFrame:
    """Speed between neighbouring fixes and its trailing median of 5."""
    d = _series(gps(spark, folder).select("flight_id", "fix_id", "tr", "e", "n", "u"), 5, 0)
    w = block_window(KEY)
    gone = lambda c: F.col(c) - F.lag(c).over(w)
    step = F.sqrt(gone("e") ** 2 + gone("n") ** 2 + gone("u") ** 2)
    d = d.withColumn("speed", F.when(gone("tr") > 1e-3, step / gone("tr")))
    d = d.withColumn("smooth", F.percentile("speed", 0.5).over(w.rowsBetween(-4, 0)))
    return owned(d).select("flight_id", "fix_id", r6("speed"), r6("smooth"))


STEP_SQL = with_sql("gps", more="s AS (SELECT *, CASE WHEN tr - lag(tr) OVER w > 1e-3 THEN sqrt((e - lag(e) OVER w) ** 2 + (n - lag(n) OVER w) ** 2 + (u - lag(u) OVER w) ** 2) / (tr - lag(tr) OVER w) END AS speed FROM gps WINDOW w AS (PARTITION BY flight_id ORDER BY tr))") + (
    "SELECT flight_id, fix_id, round(speed, 6) AS speed, round(quantile_cont(speed, 0.5) OVER (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM s"
)


def q_cumtrapz(spark: SparkSession, folder: str) -> DataFrame:
    """Distance flown along x: the running integral of vision vx by trapezoids."""
    d = in_blocks(vision(spark, folder).select("flight_id", "sample_id", "tr", "vx"), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 0)
    w = block_window(KEY)
    area = F.coalesce(0.5 * (F.col("tr") - F.lag("tr").over(w)) * (F.col("vx") + F.lag("vx").over(w)), F.lit(0.0))
    d = owned(d.withColumn("area", area))
    return running_sum(d, KEY, {"dist": F.col("area")}).select("flight_id", "sample_id", F.round("dist", 4).alias("dist"))


CUMTRAPZ_SQL = with_sql("vision", more="a AS (SELECT *, coalesce(0.5 * (tr - lag(tr) OVER w) * (vx + lag(vx) OVER w), 0) AS area FROM vision WINDOW w AS (PARTITION BY flight_id ORDER BY tr))") + (
    "SELECT flight_id, sample_id, round(sum(area) OVER (PARTITION BY flight_id ORDER BY tr ROWS UNBOUNDED PRECEDING), 4) AS dist FROM a"
)


def _course(spark: SparkSession, folder: str) -> DataFrame:
    d = _series(gps(spark, folder).select("flight_id", "fix_id", "tr", "e", "n"), 1, 1)
    w = block_window(KEY)
    return owned(d.withColumn("course", F.atan2(slope("n", "tr", w), slope("e", "tr", w))))


def q_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    """The course over ground without jumps at the half turn."""
    d = in_blocks(_course(spark, folder).drop("pos"), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 0)
    step = F.col("course") - F.lag("course").over(block_window(KEY))
    turns = F.coalesce(-F.round(step / (2 * math.pi)), F.lit(0.0))
    d = owned(d.withColumn("turn", turns))
    return running_sum(d, KEY, {"turns": F.col("turn")}).select("flight_id", "fix_id", F.round(F.col("course") + 2 * math.pi * F.col("turns"), 6).alias("course"))


_COURSE_SQL = f"c AS (SELECT *, atan2({slope_sql('n')}, {slope_sql('e')}) AS course FROM gps WINDOW w AS (PARTITION BY flight_id ORDER BY tr))"
UNWRAP_SQL = with_sql("gps", more=_COURSE_SQL + ", s AS (SELECT *, coalesce(-round((course - lag(course) OVER (PARTITION BY flight_id ORDER BY tr)) / (2 * pi())), 0) AS turn FROM c)") + (
    "SELECT flight_id, fix_id, round(course + 2 * pi() * sum(turn) OVER (PARTITION BY flight_id ORDER BY tr ROWS UNBOUNDED PRECEDING), 6) AS course FROM s"
)


def q_circular_mean(spark: SparkSession, folder: str) -> DataFrame:
    out = _course(spark, folder).groupBy("flight_id").agg(F.count("*").alias("n"), F.atan2(F.avg(F.sin("course")), F.avg(F.cos("course"))).alias("m"))
    wrapped = F.pmod(F.col("m") + math.pi, F.lit(2 * math.pi)) - math.pi
    return out.select("flight_id", "n", F.round("m", 6).alias("mean_course"), F.round(wrapped, 6).alias("wrapped"))


CIRCULAR_SQL = with_sql("gps", more=_COURSE_SQL + ", m AS (SELECT flight_id, count(*) AS n, atan2(avg(sin(course)), avg(cos(course))) AS m FROM c GROUP BY 1)") + (
    "SELECT flight_id, n, round(m, 6) AS mean_course, round((m + pi()) - 2 * pi() * floor((m + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM m"
)


def q_monotonic(spark: SparkSession, folder: str) -> DataFrame:
    """Log order against time: how often bag_t steps back, repeats, or leaps by more than ten seconds, per flight, in order of sample_id."""
    b = table(spark, folder, "baro_corrected").select("flight_id", "sample_id", "bag_t")
    d = in_blocks(b, KEY, ["sample_id"], F.floor(F.col("sample_id") / 100_000), 1, 0)
    step = F.col("bag_t") - F.lag("bag_t").over(block_window(KEY))
    d = owned(d.withColumn("step", step))
    return d.groupBy("flight_id").agg(F.count_if(F.col("step") < 0).alias("back"), F.count_if(F.col("step") == 0).alias("same"), F.count_if(F.col("step") > 10).alias("leaps"), F.count("*").alias("n"))


MONOTONIC_SQL = """SELECT flight_id, count(*) FILTER (step < 0) AS back, count(*) FILTER (step = 0) AS same, count(*) FILTER (step > 10) AS leaps, count(*) AS n
FROM (SELECT flight_id, bag_t - lag(bag_t) OVER (PARTITION BY flight_id ORDER BY sample_id) AS step FROM baro_corrected) GROUP BY flight_id"""


def q_decimate(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth fix of a flight, from the first on."""
    d = with_positions(gps(spark, folder).select("flight_id", "fix_id", "tr"), KEY, ["tr"], F.floor(F.col("tr") / 600))
    return d.filter(F.pmod("pos", F.lit(10)) == 0).select("flight_id", "fix_id", F.col("pos").alias("place"))


DECIMATE_SQL = with_sql("gps") + "SELECT flight_id, fix_id, i AS place FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY tr) - 1 AS i FROM gps) WHERE i % 10 = 0"


def q_flow_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gates on flow frames: time step against the flight's median, tracking quality, size of the flow; and their union."""
    f = flow(spark, folder)
    mid = cut(exact_percentiles(f, KEY, "dt_s", {"mid": 0.5}).drop("n"))
    d = join_checked(f, mid, KEY)
    dt = F.coalesce((F.col("dt_s") < 0.5 * F.col("mid")) | (F.col("dt_s") > 2 * F.col("mid")), F.lit(True))
    quality = (F.coalesce("valid_filt", F.lit(0.0)) <= 0) | (F.coalesce("n_good_tracks", F.lit(0.0)) < 10) | (F.coalesce("quality_good_tracks_ratio", F.lit(0.0)) < 0.01)
    size = F.coalesce(F.hypot("flow_x_px_s_filt", "flow_y_px_s_filt") > 400, F.lit(True))
    flags = d.select("flight_id", dt.alias("dt"), quality.alias("q"), size.alias("s"))
    return flags.groupBy("flight_id").agg(F.count("*").alias("n"), F.count_if("dt").alias("dt_bad"), F.count_if("q").alias("quality_bad"), F.count_if("s").alias("physical_bad"), F.count_if(F.col("dt") | F.col("q") | F.col("s")).alias("bad"))


GATES_SQL = with_sql("flow", more="m AS (SELECT flight_id, quantile_cont(dt_s, 0.5) AS mid FROM flow GROUP BY 1), g AS (SELECT flight_id, coalesce(dt_s < 0.5 * mid OR dt_s > 2 * mid, TRUE) AS dt, coalesce(valid_filt, 0) <= 0 OR coalesce(n_good_tracks, 0) < 10 OR coalesce(quality_good_tracks_ratio, 0) < 0.01 AS q, coalesce(sqrt(flow_x_px_s_filt ** 2 + flow_y_px_s_filt ** 2) > 400, TRUE) AS s FROM flow JOIN m USING (flight_id))") + (
    "SELECT flight_id, count(*) AS n, count(*) FILTER (dt) AS dt_bad, count(*) FILTER (q) AS quality_bad, count(*) FILTER (s) AS physical_bad, count(*) FILTER (dt OR q OR s) AS bad FROM g GROUP BY flight_id"
)

QUERIES = {
    "q_rolling_median_mean": q_rolling_median_mean,
    "q_rolling_mad_gate": q_rolling_mad_gate,
    "q_centered_median": q_centered_median,
    "q_fill_bf_ff": q_fill_bf_ff,
    "q_gradient": q_gradient,
    "q_step_speed": q_step_speed,
    "q_cumtrapz": q_cumtrapz,
    "q_unwrap": q_unwrap,
    "q_circular_mean": q_circular_mean,
    "q_monotonic": q_monotonic,
    "q_decimate": q_decimate,
    "q_flow_gates": q_flow_gates,
}
SQL = {
    "q_rolling_median_mean": MEDIAN_MEAN_SQL,
    "q_rolling_mad_gate": MAD_SQL,
    "q_centered_median": CENTERED_SQL,
    "q_fill_bf_ff": FILL_SQL,
    "q_gradient": GRADIENT_SQL,
    "q_step_speed": STEP_SQL,
    "q_cumtrapz": CUMTRAPZ_SQL,
    "q_unwrap": UNWRAP_SQL,
    "q_circular_mean": CIRCULAR_SQL,
    "q_monotonic": MONOTONIC_SQL,
    "q_decimate": DECIMATE_SQL,
    "q_flow_gates": GATES_SQL,
}
