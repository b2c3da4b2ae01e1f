"""Queries that estimate delays, offsets and velocities between sensors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions import motion
from tracklane.operators.align import asof, interpolate
from tracklane.operators.delays import at_delays, judged_delay, middle, residual_scores
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, owned, slope
from tracklane.operators.joins import join_checked
from tracklane.plans.alignment import KEY, delay_grid, slope_sql
from tracklane.session import cut
from tracklane.sources.sensors import attitude, baro, flow, gps, messages, starlink, with_sql

TWO_PI = 2 * math.pi
COURSE_FEW, COURSE_REACH = 200, 1.0
FX, FY = motion.focal_px(384, 40.0), motion.focal_px(288, 30.0)


def _wrap(x):
    return F.pmod(x + math.pi, F.lit(TWO_PI)) - math.pi


def q_course_delay(spark: SparkSession, folder: str) -> DataFrame:
    """Delay of the dense fixes against the attitude, in whatever unit that was recorded: the course over ground beside the yaw at t - delay, on a grid by 0.02 s, without their constant difference; the delay of the least median, with the 90th percentile and what makes it doubtful."""
    yaw = attitude(spark, folder, "yaw").select("flight_id", "tr", F.sin("yaw").alias("s"), F.cos("yaw").alias("c"))  # points on the circle: no unwrapping
    d = in_blocks(gps(spark, folder).select("flight_id", "tr", "e", "n"), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 1)
    w = block_window(KEY)
    d = owned(d.withColumn("ve", slope("e", "tr", w)).withColumn("vn", slope("n", "tr", w))).filter(F.hypot("ve", "vn") > 2)
    d = at_delays(d.select("flight_id", "tr", F.atan2("ve", "vn").alias("course")), yaw, KEY, "tr", ["s", "c"], delay_grid(COURSE_REACH))
    d = d.select("flight_id", "delay", _wrap(F.col("course") - F.atan2("s_at", "c_at")).alias("off"))
    bias = lambda: [F.atan2(F.avg(F.sin("off")), F.avg(F.cos("off"))).alias("bias")]
    scored = residual_scores(d, KEY, bias, F.abs(_wrap(F.col("off") - F.col("bias"))), {"score": middle("res"), "p90": middle("res", 0.9)})
    return judged_delay(scored, KEY, "p90", COURSE_REACH, math.radians(0.5), COURSE_FEW)


def q_enu_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Constant offset of the sparse fixes: median distance east, north and up to the interpolated dense ones while these move faster than 1 m/s (where that leaves fewer than five, of all), and the RMSE before and after taking it off."""
    g = in_blocks(gps(spark, folder).select("flight_id", "tr", "e", "n", "u"), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 1)
    w = block_window(KEY)
    g = owned(g.withColumn("speed", F.hypot(slope("e", "tr", w), slope("n", "tr", w)))).select("flight_id", "tr", *(F.col(c).alias(f"g{c}") for c in "enu"), "speed")
    s = starlink(spark, folder).select("flight_id", "fix_id", "tr", "e", "n", "u")
    d = interpolate(s, g, KEY, "tr", ["ge", "gn", "gu", "speed"]).filter("ge_at IS NOT NULL")
    d = cut(d.select("flight_id", *((F.col(c) - F.col(f"g{c}_at")).alias(f"d{c}") for c in "enu"), ((F.col("tr") >= 0) & (F.col("speed_at") > 1)).alias("moving")))
    mode = cut(d.groupBy("flight_id").agg((F.count_if("moving") >= 5).alias("by_moving")))
    d = join_checked(d, mode, KEY).filter("moving OR NOT by_moving")
    axes = d.select("flight_id", F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(f"d{c}").alias("x")) for c in "enu"))).alias("a")).select("flight_id", "a.*")
    off = exact_percentiles(axes, [*KEY, "axis"], "x", {"mid": 0.5}).groupBy("flight_id").agg(*(F.max(F.when(F.col("axis") == c, F.col("mid"))).alias(f"o{c}") for c in "enu"))
    d = join_checked(d, cut(off), KEY)
    rms = lambda *xs: F.round(F.sqrt(F.avg(sum((x * x for x in xs), F.lit(0.0)))), 5)
    left = [F.col(f"d{c}") - F.col(f"o{c}") for c in "enu"]
    return d.groupBy("flight_id").agg(
        F.count("*").alias("n"), F.when(F.max("by_moving"), "moving").otherwise("all").alias("mode"), *(F.round(F.max(f"o{c}"), 5).alias(f"off_{c}") for c in "enu"),
        rms(F.col("de"), F.col("dn")).alias("before"), rms(*left[:2]).alias("after"), rms(left[2]).alias("after_u"), rms(*left).alias("after_3d"),
    )


_AT = "CASE WHEN t1 IS NULL THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * ((tr - t0) / (t1 - t0)) END"
ENU_OFFSET_SQL = with_sql("gps", "starlink", more=f"""g0 AS (SELECT flight_id, tr, e, n, u, {slope_sql('e')} AS ve, {slope_sql('n')} AS vn FROM gps WINDOW w AS (PARTITION BY flight_id ORDER BY tr)),
g AS (SELECT *, sqrt(ve ** 2 + vn ** 2) AS s FROM g0),
j AS (SELECT s.*, p.tr AS t0, p.e AS e0, p.n AS n0, p.u AS u0, p.s AS s0, q.tr AS t1, q.e AS e1, q.n AS n1, q.u AS u1, q.s AS s1 FROM starlink s
  ASOF JOIN g p ON s.flight_id = p.flight_id AND s.tr >= p.tr ASOF LEFT JOIN g q ON s.flight_id = q.flight_id AND s.tr < q.tr),
d0 AS (SELECT flight_id, {", ".join(f"{c} - {_AT.format(c=c)} AS d{c}" for c in "enu")}, tr >= 0 AND {_AT.format(c="s")} > 1 AS moving FROM j WHERE t1 IS NOT NULL OR t0 = tr),
d1 AS (SELECT *, count(*) FILTER (moving) OVER (PARTITION BY flight_id) >= 5 AS by_moving FROM d0), d AS (SELECT * FROM d1 WHERE moving OR NOT by_moving),
o AS (SELECT flight_id, quantile_cont(de, 0.5) AS oe, quantile_cont(dn, 0.5) AS o_n, quantile_cont(du, 0.5) AS ou FROM d GROUP BY 1)""") + (
    "SELECT flight_id, count(*) AS n, CASE WHEN bool_or(by_moving) THEN 'moving' ELSE 'all' END AS mode, round(max(oe), 5) AS off_e, round(max(o_n), 5) AS off_n, round(max(ou), 5) AS off_u, round(sqrt(avg(de ** 2 + dn ** 2)), 5) AS before, "
    "round(sqrt(avg((de - oe) ** 2 + (dn - o_n) ** 2)), 5) AS after, round(sqrt(avg((du - ou) ** 2)), 5) AS after_u, round(sqrt(avg((de - oe) ** 2 + (dn - o_n) ** 2 + (du - ou) ** 2)), 5) AS after_3d FROM d JOIN o USING (flight_id) GROUP BY 1"
)


def q_metric_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Flow frames as velocities over ground with the barometer height before them, behind the first gate: step, height and speed within bounds."""
    f = flow(spark, folder).filter("t_sec IS NOT NULL").select("flight_id", "frame_idx", F.col("t_sec").alias("tr"), "dt_s", "flow_x_px_s_filt", "flow_y_px_s_filt")
    d = asof(f, baro(spark, folder).select("flight_id", "tr", "u"), KEY, "tr", ["u"], tolerance=5.0)
    rx, ry = motion.angular_flow(motion.clip(F.col("flow_x_px_s_filt"), 400.0) * F.col("dt_s"), motion.clip(F.col("flow_y_px_s_filt"), 400.0) * F.col("dt_s"), F.col("dt_s"), FX, FY)
    vx, vy = motion.metric_velocity(rx, ry, motion.distance_to_ground(F.col("u"), F.lit(0.0), F.lit(0.0)))
    d = d.withColumn("vx", vx).withColumn("vy", vy)
    good = F.col("dt_s").between(0.005, 1.0) & F.col("u").between(5.0, 2000.0) & (F.hypot("vx", "vy") <= 120)
    return d.select("flight_id", "frame_idx", F.round("vx", 5).alias("vx"), F.round("vy", 5).alias("vy"), F.coalesce(good, F.lit(False)).alias("valid"))


METRIC_SQL = with_sql("flow", "baro", more=f"""f AS (SELECT * FROM flow WHERE t_sec IS NOT NULL),
j AS (SELECT f.*, CASE WHEN f.t_sec - b.tr <= 5.0 THEN b.u END AS u FROM f ASOF LEFT JOIN baro b ON f.flight_id = b.flight_id AND f.t_sec >= b.tr),
v AS (SELECT *, CASE WHEN dt_s > 0 THEN -u * ((CASE WHEN flow_x_px_s_filt IS NOT NULL THEN greatest(-400, least(400, flow_x_px_s_filt)) END * dt_s / {FX}) / dt_s) END AS vx,
  CASE WHEN dt_s > 0 THEN -u * ((CASE WHEN flow_y_px_s_filt IS NOT NULL THEN greatest(-400, least(400, flow_y_px_s_filt)) END * dt_s / {FY}) / dt_s) END AS vy FROM j)""") + (
    "SELECT flight_id, frame_idx, round(vx, 5) AS vx, round(vy, 5) AS vy, coalesce(dt_s BETWEEN 0.005 AND 1.0 AND u BETWEEN 5 AND 2000 AND sqrt(vx ** 2 + vy ** 2) <= 120, FALSE) AS valid FROM v"
)


def q_clock_window(spark: SparkSession, folder: str) -> DataFrame:
    """Messages from the fifth second of a flight's log to the 65th, both ends in: how many of each topic, and the spread of arrival behind the stamp."""
    m = messages(spark, folder)
    t0 = cut(m.groupBy("flight_id").agg(F.min("bag_timestamp_ns").alias("t0")))
    m = join_checked(m, t0, KEY).filter((F.col("bag_timestamp_ns") - F.col("t0")).between(5 * 10**9, 65 * 10**9))
    lag = F.when(F.col("header_stamp_ns") > 0, F.col("bag_timestamp_ns") - F.col("header_stamp_ns"))
    return m.groupBy("flight_id", "topic").agg(F.count("*").alias("n"), F.min(lag).alias("least_lag"), F.max(lag).alias("most_lag"))


CLOCK_SQL = with_sql("messages", more="w AS (SELECT *, min(bag_timestamp_ns) OVER (PARTITION BY flight_id) AS t0, CASE WHEN header_stamp_ns > 0 THEN bag_timestamp_ns - header_stamp_ns END AS lag FROM messages)") + (
    "SELECT flight_id, topic, count(*) AS n, min(lag) AS least_lag, max(lag) AS most_lag FROM w WHERE bag_timestamp_ns - t0 BETWEEN 5000000000 AND 65000000000 GROUP BY 1, 2"
)


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and v.__module__ == __name__}
SQL = {"q_enu_offset": ENU_OFFSET_SQL, "q_metric_velocity": METRIC_SQL, "q_clock_window": CLOCK_SQL}
