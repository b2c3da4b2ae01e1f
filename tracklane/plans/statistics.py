"""Queries of robust statistics, regressions, counts and checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.functions.missing import finite
from tracklane.operators.align import asof, interpolate
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, owned
from tracklane.operators.joins import join_checked
from tracklane.operators.positions import with_positions
from tracklane.operators.robust import robust_sigma, robust_vector_mean
from tracklane.plans.alignment import ERRORS, KEY, errors, r6, trim_sql
from tracklane.session import cut
from tracklane.sources.sensors import attitude, baro, flow, gps, messages, starlink, vision, with_sql
from tracklane.sources.tables import table


def q_robust_sigma(spark: SparkSession, folder: str) -> DataFrame:
    """Median, MAD and robust sigma of vision vx per flight (null under 10 rows; the plain deviation where the MAD is 0), and the limit four sigmas up, 5 at least."""
    out = robust_sigma(vision(spark, folder), KEY, "vx")
    limit = F.greatest(F.lit(5.0), F.col("mid") + 4 * 1.4826 * F.col("mad"))
    return out.select("flight_id", "n", r6("mid"), r6("mad"), r6("sigma"), F.round(limit, 6).alias("upper"))


SIGMA_SQL = with_sql("vision", more="m AS (SELECT flight_id, count(*) AS n, quantile_cont(vx, 0.5) AS mid, mad(vx) AS mad, stddev_pop(vx) AS sd FROM vision GROUP BY 1)") + (
    "SELECT flight_id, n, round(mid, 6) AS mid, round(mad, 6) AS mad, round(CASE WHEN n >= 10 THEN CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END END, 6) AS sigma, round(greatest(5.0, mid + 4 * 1.4826 * mad), 6) AS upper FROM m"
)


def q_node_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Vision velocities averaged robustly at the nodes of a 0.5 Hz grid; bins of fewer than three rows are left out."""
    v = vision(spark, folder).withColumn("node", F.floor(F.col("tr") / 2))
    out = robust_vector_mean(v, ["flight_id", "node"], ["vx", "vy", "vz"])
    return out.filter("n >= 3").select("flight_id", "node", "n", "kept", *(F.round(c, 6).alias(c) for c in ("vx", "vy", "vz")))


NODE_SQL = with_sql("vision", more=trim_sql("vision", "CAST(floor(tr / 2) AS BIGINT)")) + (
    "SELECT flight_id, k AS node, n, count(*) FILTER (NOT does OR near) AS kept, round(avg(vx) FILTER (NOT does OR near), 6) AS vx, round(avg(vy) FILTER (NOT does OR near), 6) AS vy, "
    "round(avg(vz) FILTER (NOT does OR near), 6) AS vz FROM tu WHERE n >= 3 GROUP BY 1, 2, 3"
)


NODE_S, FLUSH_S = 2.0, 0.057 + 0.02  # seconds of a node, and how long after its end it waits for rows


def q_node_flush(spark: SparkSession, folder: str) -> DataFrame:
    """Vision velocities averaged robustly at nodes by measurement time, of the rows that had arrived when their node was flushed; nodes of three such rows or more, with how many came too late."""
    end = (F.floor(F.col("tr") / NODE_S) + 1) * NODE_S
    v = vision(spark, folder).filter(finite(F.col("tr_arrival"))).withColumn("node", F.floor(F.col("tr") / NODE_S)).withColumn("late", F.col("tr_arrival") > end + FLUSH_S)
    late = v.groupBy("flight_id", "node").agg(F.count_if("late").alias("late"))
    out = robust_vector_mean(v.filter("NOT late"), ["flight_id", "node"], ["vx", "vy", "vz"]).filter("n >= 3")
    return out.join(late, ["flight_id", "node"]).select("flight_id", "node", "n", "kept", "late", *(F.round(c, 6).alias(c) for c in ("vx", "vy", "vz")))


_NODE = f"CAST(floor(tr / {NODE_S}) AS BIGINT)"
FLUSH_SQL = with_sql("vision", more=f"vn AS (SELECT *, {_NODE} AS node, tr_arrival > (floor(tr / {NODE_S}) + 1) * {NODE_S} + {FLUSH_S} AS late FROM vision WHERE isfinite(tr_arrival)), vf AS (SELECT * FROM vn WHERE NOT late), " + trim_sql("vf", _NODE)) + (
    "SELECT flight_id, k AS node, n, count(*) FILTER (NOT does OR near) AS kept, any_value(l.late) AS late, round(avg(vx) FILTER (NOT does OR near), 6) AS vx, round(avg(vy) FILTER (NOT does OR near), 6) AS vy, "
    "round(avg(vz) FILTER (NOT does OR near), 6) AS vz FROM tu JOIN (SELECT flight_id, node AS k, count(*) FILTER (late) AS late FROM vn GROUP BY 1, 2) l USING (flight_id, k) WHERE n >= 3 GROUP BY 1, 2, 3"
)


def _height_speed(spark: SparkSession, folder: str) -> DataFrame:
    """Height error with the vision speed before it."""
    v = vision(spark, folder).select("flight_id", "tr", F.hypot("vx", "vy").alias("speed"))
    d = asof(errors(spark, folder).select("flight_id", "sample_id", "tr", "err"), v, KEY, "tr", ["speed"])
    return d.filter("speed IS NOT NULL").select("flight_id", "tr", "err", "speed")


_SPEED = ERRORS + ", h AS (SELECT er.flight_id, er.tr, err, sqrt(v.vx ** 2 + v.vy ** 2) AS speed FROM er ASOF JOIN vision v ON er.flight_id = v.flight_id AND er.tr >= v.tr)"


def q_linear_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Line of the height error over time per flight, and the RMS of what it leaves."""
    d = _height_speed(spark, folder)
    fit = cut(d.groupBy("flight_id").agg(F.regr_slope("err", "tr").alias("slope"), F.regr_intercept("err", "tr").alias("at0")))
    left = F.col("err") - (F.col("at0") + F.col("slope") * F.col("tr"))
    out = join_checked(d, fit, KEY).groupBy("flight_id", "slope", "at0").agg(F.count("*").alias("n"), F.sqrt(F.avg(left * left)).alias("rms"))
    return out.select("flight_id", "n", r6("slope"), F.round("at0", 5).alias("at0"), r6("rms"))


FIT_SQL = with_sql("gps", "baro", "vision", more=_SPEED + ", f AS (SELECT flight_id, regr_slope(err, tr) AS slope, regr_intercept(err, tr) AS at0 FROM h GROUP BY 1)") + (
    "SELECT flight_id, count(*) AS n, round(slope, 6) AS slope, round(at0, 5) AS at0, round(sqrt(avg((err - (at0 + slope * tr)) ** 2)), 6) AS rms FROM h JOIN f USING (flight_id) GROUP BY flight_id, slope, at0"
)


def q_speed_split(spark: SparkSession, folder: str) -> DataFrame:
    """Height error against speed: their correlation, and bias and RMSE of the slower and faster half."""
    d = _height_speed(spark, folder)
    mid = cut(exact_percentiles(d, KEY, "speed", {"mid": 0.5}).drop("n"))
    slow = F.col("speed") <= F.col("mid")
    part = lambda c: (F.avg(F.when(c, F.col("err"))), F.sqrt(F.avg(F.when(c, F.col("err") ** 2))))
    (b0, r0), (b1, r1) = part(slow), part(~slow)
    out = join_checked(d, mid, KEY).groupBy("flight_id").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("err", "speed")).alias("corr"), b0.alias("slow_bias"), r0.alias("slow_rmse"), b1.alias("fast_bias"), r1.alias("fast_rmse"))
    return out.select("flight_id", "n", *map(r6, ("corr", "slow_bias", "slow_rmse", "fast_bias", "fast_rmse")))


SPLIT_SQL = with_sql("gps", "baro", "vision", more=_SPEED + ", m AS (SELECT flight_id, quantile_cont(speed, 0.5) AS mid FROM h GROUP BY 1)") + (
    "SELECT flight_id, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(err, speed) END, 6) AS corr, round(avg(err) FILTER (speed <= mid), 6) AS slow_bias, round(sqrt(avg(err ** 2) FILTER (speed <= mid)), 6) AS slow_rmse, "
    "round(avg(err) FILTER (speed > mid), 6) AS fast_bias, round(sqrt(avg(err ** 2) FILTER (speed > mid)), 6) AS fast_rmse FROM h JOIN m USING (flight_id) GROUP BY flight_id"
)


def q_geo_enu(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes in metres east, north and up of the flight's first fix, from latitude, longitude and height."""
    g = gps(spark, folder)
    origin = cut(g.groupBy("flight_id").agg(F.min_by(F.struct("lat", "lon", "alt"), "tr").alias("o")).select("flight_id", *(F.col(f"o.{c}").alias(f"{c}0") for c in ("lat", "lon", "alt"))))
    e, n, u = geo.enu(*map(F.col, ("lat", "lon", "alt", "lat0", "lon0", "alt0")))
    return join_checked(g, origin, KEY).select("flight_id", "fix_id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"), F.round(u, 3).alias("up"))


GEO_SQL = with_sql("gps", more="o AS (SELECT flight_id, arg_min(lat, tr) AS lat0, arg_min(lon, tr) AS lon0, arg_min(alt, tr) AS alt0 FROM gps GROUP BY 1)," + geo.ENU_SQL) + (
    "SELECT flight_id, fix_id, round(east, 3) AS east, round(north, 3) AS north, round(up, 3) AS up FROM enu"
)


def q_geo_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Latitude, longitude and height of the fixes, got back from their metres east, north and up of the flight's first fix."""
    g = gps(spark, folder)
    origin = cut(g.groupBy("flight_id").agg(F.min_by(F.struct("lat", "lon", "alt"), "tr").alias("o")).select("flight_id", *(F.col(f"o.{c}").alias(f"{c}0") for c in ("lat", "lon", "alt"))))
    at = [*map(F.col, ("lat0", "lon0", "alt0"))]
    d = join_checked(g, origin, KEY)
    d = d.withColumns(dict(zip(("east", "north", "up"), geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), *at), strict=True))).drop("lat", "lon", "alt")
    d = d.withColumns(dict(zip("xyz", geo.from_enu(F.col("east"), F.col("north"), F.col("up"), *at), strict=True)))
    d = geo.geodetic(d, "x", "y", "z")
    return d.select("flight_id", "fix_id", F.round("lat_at", 8).alias("lat"), F.round("lon_at", 8).alias("lon"), F.round("alt_at", 4).alias("alt"))


ROUND_TRIP_SQL = with_sql("gps") + "SELECT flight_id, fix_id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 4) AS alt FROM gps"


def q_body_to_enu(spark: SparkSession, folder: str) -> DataFrame:
    """Body velocity within the speed bound, turned into east, north, up by the attitude before it, in whatever unit that was recorded; its age, and whether its unit is in doubt."""
    v = vision(spark, folder).select("flight_id", "sample_id", "tr", "vx", "vy", "vz").filter(F.hypot("vx", "vy") <= 60)
    d = asof(v, attitude(spark, folder, "roll", "pitch", "yaw"), KEY, "tr", ["roll", "pitch", "yaw", "unsure"]).filter("yaw IS NOT NULL")
    east, north, up = geo.body_to_enu(*map(F.col, ("vx", "vy", "vz", "roll", "pitch", "yaw")))
    return d.select("flight_id", "sample_id", F.round(east, 5).alias("ve"), F.round(north, 5).alias("vn"), F.round(up, 5).alias("vu"), F.round("age", 5).alias("age"), "unsure")


def q_origin(spark: SparkSession, folder: str) -> DataFrame:
    """Origin of a flight: the median position of its first five seconds, or where these hold fewer than five fixes of its first fifty fixes."""
    g = with_positions(gps(spark, folder).select("flight_id", "tr", "lat", "lon", "alt"), KEY, ["tr"], F.floor(F.col("tr") / 600))
    first = cut(g.groupBy("flight_id").agg(F.min("tr").alias("t0")))
    g = join_checked(g, first, KEY).withColumn("early", F.col("tr") <= F.col("t0") + 5).filter("early OR pos < 50")
    few = cut(g.groupBy("flight_id").agg((F.count_if("early") < 5).alias("few")))
    d = join_checked(g, few, KEY).filter("CASE WHEN few THEN pos < 50 ELSE early END")
    axes = d.select("flight_id", F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).alias("x")) for c in ("lat", "lon", "alt")))).alias("a")).select("flight_id", "a.*")
    mid = exact_percentiles(axes, [*KEY, "axis"], "x", {"mid": 0.5}).groupBy("flight_id")
    return mid.agg(F.max("n").alias("n"), *(F.round(F.max(F.when(F.col("axis") == c, F.col("mid"))), d).alias(f"{c}0") for c, d in (("lat", 8), ("lon", 8), ("alt", 6))))


ORIGIN_SQL = with_sql("gps", more="""f AS (SELECT *, min(tr) OVER k AS t0, row_number() OVER (PARTITION BY flight_id ORDER BY tr) - 1 AS pos FROM gps WINDOW k AS (PARTITION BY flight_id)),
g AS (SELECT *, tr <= t0 + 5 AS early, count(*) FILTER (tr <= t0 + 5) OVER (PARTITION BY flight_id) < 5 AS few FROM f)""") + (
    "SELECT flight_id, count(*) AS n, round(quantile_cont(lat, 0.5), 8) AS lat0, round(quantile_cont(lon, 0.5), 8) AS lon0, round(quantile_cont(alt, 0.5), 6) AS alt0 "
    "FROM g WHERE CASE WHEN few THEN pos < 50 ELSE early END GROUP BY flight_id"
)


def q_baro_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Barometer offset: the median distance to the reference (its ends held) in the first 180 s of a flight; where these hold no more than ten heights in all the time the reference covers, and with no more than ten there 0."""
    b = baro(spark, folder).select("flight_id", "tr", "u")
    g = gps(spark, folder).select("flight_id", "tr", F.col("u").alias("g"))
    ends = cut(g.groupBy("flight_id").agg(F.min("tr").alias("a"), F.max("tr").alias("b")))
    d = join_checked(interpolate(b, g, KEY, "tr", ["g"], clamp=True), ends, KEY, "inner")
    d = cut(d.select("flight_id", (F.col("u") - F.col("g_at")).alias("d"), F.col("tr").between(0.0, 180.0).alias("early"), F.col("tr").between(F.col("a"), F.col("b")).alias("covered")))
    mode = F.when(F.count_if("early") > 10, "early").when(F.count_if("covered") > 10, "covered").otherwise("none")
    d = join_checked(d, cut(d.groupBy("flight_id").agg(mode.alias("mode"))), KEY)
    used = d.filter("CASE mode WHEN 'early' THEN early WHEN 'covered' THEN covered ELSE TRUE END")
    out = exact_percentiles(used, ["flight_id", "mode"], "d", {"offset": 0.5})
    return out.select("flight_id", "mode", "n", F.round(F.when(F.col("mode") == "none", 0.0).otherwise(F.col("offset")), 6).alias("offset"))


OFFSET_SQL = with_sql("gps", "baro", more="""r AS (SELECT flight_id, min(tr) AS a, max(tr) AS b FROM gps GROUP BY 1),
j AS (SELECT b.flight_id, b.tr, b.u, p.tr AS t0, p.u AS u0, q.tr AS t1, q.u AS u1, r.a, r.b FROM baro b JOIN r ON r.flight_id = b.flight_id ASOF LEFT JOIN gps p ON b.flight_id = p.flight_id AND b.tr >= p.tr
  ASOF LEFT JOIN gps q ON b.flight_id = q.flight_id AND b.tr < q.tr),
d AS (SELECT flight_id, u - CASE WHEN t0 IS NULL THEN u1 WHEN t1 IS NULL THEN u0 ELSE u0 + (u1 - u0) * ((tr - t0) / (t1 - t0)) END AS d, tr BETWEEN 0 AND 180 AS early, tr BETWEEN a AND b AS covered FROM j),
m AS (SELECT *, CASE WHEN count(*) FILTER (early) OVER k > 10 THEN 'early' WHEN count(*) FILTER (covered) OVER k > 10 THEN 'covered' ELSE 'none' END AS mode FROM d WINDOW k AS (PARTITION BY flight_id))""") + (
    """SELECT flight_id, mode, count(*) AS n, round(CASE WHEN mode = 'none' THEN 0.0 ELSE quantile_cont(d, 0.5) END, 6) AS "offset" FROM m WHERE CASE mode WHEN 'early' THEN early WHEN 'covered' THEN covered ELSE TRUE END GROUP BY flight_id, mode"""
)


def q_starlink_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse fixes judged: distance to the interpolated reference, step and gap to the fix before, and what is wrong with it."""
    s = starlink(spark, folder).select("flight_id", "fix_id", "tr", "e", "n")
    g = gps(spark, folder).select("flight_id", "tr", F.col("e").alias("ge"), F.col("n").alias("gn"))
    d = interpolate(s, g, KEY, "tr", ["ge", "gn"], clamp=True)
    d = in_blocks(d.withColumn("err", F.hypot(F.col("e") - F.col("ge_at"), F.col("n") - F.col("gn_at"))), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 0)
    w = block_window(KEY)
    gap = F.col("tr") - F.lag("tr").over(w)
    step = F.hypot(F.col("e") - F.lag("e").over(w), F.col("n") - F.lag("n").over(w))
    d = owned(d.withColumn("gap", gap).withColumn("step", step))
    limits = cut(robust_sigma(d.filter("err IS NOT NULL"), KEY, "err").select("flight_id", F.greatest(F.lit(30.0), F.col("mid") + 4 * 1.4826 * F.col("mad")).alias("top")))
    d = join_checked(d, limits, KEY)
    issue = F.concat_ws("+", F.when(F.col("step") == 0, "stale"), F.when(F.col("gap") > 60, "gap"), F.when(F.col("err") > F.col("top"), "outlier"))
    return d.select("flight_id", "fix_id", F.round("err", 5).alias("err"), F.round("gap", 5).alias("gap"), F.round("step", 5).alias("step"), issue.alias("issue"))


STARLINK_SQL = with_sql("gps", "starlink", more="""j AS (SELECT s.*, p.tr AS t0, p.e AS e0, p.n AS n0, q.tr AS t1, q.e AS e1, q.n AS n1 FROM starlink s
  ASOF LEFT JOIN gps p ON s.flight_id = p.flight_id AND s.tr >= p.tr ASOF LEFT JOIN gps q ON s.flight_id = q.flight_id AND s.tr < q.tr),
i AS (SELECT *, CASE WHEN t0 IS NULL THEN e1 WHEN t1 IS NULL THEN e0 ELSE e0 + (e1 - e0) * ((tr - t0) / (t1 - t0)) END AS ge, CASE WHEN t0 IS NULL THEN n1 WHEN t1 IS NULL THEN n0 ELSE n0 + (n1 - n0) * ((tr - t0) / (t1 - t0)) END AS gn FROM j),
d AS (SELECT *, sqrt((e - ge) ** 2 + (n - gn) ** 2) AS err, tr - lag(tr) OVER w AS gap, sqrt((e - lag(e) OVER w) ** 2 + (n - lag(n) OVER w) ** 2) AS step FROM i WINDOW w AS (PARTITION BY flight_id ORDER BY tr)),
l AS (SELECT flight_id, greatest(30.0, quantile_cont(err, 0.5) + 4 * 1.4826 * mad(err)) AS top FROM d WHERE err IS NOT NULL GROUP BY 1)""") + (
    "SELECT flight_id, fix_id, round(err, 5) AS err, round(gap, 5) AS gap, round(step, 5) AS step, concat_ws('+', CASE WHEN step = 0 THEN 'stale' END, CASE WHEN gap > 60 THEN 'gap' END, CASE WHEN err > top THEN 'outlier' END) AS issue FROM d LEFT JOIN l USING (flight_id)"
)


def q_time_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """First and last time and number of rows of each sensor: a union by name."""
    out = None
    for name, d in (("gps", gps(spark, folder)), ("starlink", starlink(spark, folder)), ("baro", baro(spark, folder)), ("vision", vision(spark, folder))):
        part = d.agg(F.count("*").alias("n"), F.round(F.min("tr"), 6).alias("first"), F.round(F.max("tr"), 6).alias("last")).withColumn("sensor", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


RANGES_SQL = with_sql("gps", "starlink", "baro", "vision") + " UNION ALL ".join(
    f'SELECT \'{t}\' AS sensor, count(*) AS n, round(min(tr), 6) AS "first", round(max(tr), 6) AS "last" FROM {t}' for t in ("gps", "starlink", "baro", "vision")
)


def q_topk_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty largest horizontal errors of all runs and bins."""
    e = table(spark, folder, "error_by_time_bin").filter(finite(F.col("rmse_xy_m"))).select("flight_id", "run_name", "matching_mode", "bin_id", "rmse_xy_m").distinct()
    return e.orderBy(F.desc("rmse_xy_m"), "flight_id", "run_name", "matching_mode", "bin_id").limit(20)


TOPK_SQL = """SELECT DISTINCT flight_id, run_name, matching_mode, bin_id, rmse_xy_m FROM error_by_time_bin WHERE isfinite(rmse_xy_m)
ORDER BY rmse_xy_m DESC, flight_id, run_name, matching_mode, bin_id LIMIT 20"""


def q_pivot_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Samples per series and matching mode, modes side by side, and whether they are as many."""
    d = table(spark, folder, "fusion_height_aligned_samples").filter(F.col("err_u").isNotNull())
    p = d.groupBy("series").pivot("matching_mode", ["causal_backward", "offline_interp"]).count()
    return p.select("series", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("causal_backward", "offline_interp")), F.col("causal_backward").eqNullSafe(F.col("offline_interp")).alias("equal"))


PIVOT_SQL = """SELECT series, count(*) FILTER (matching_mode = 'causal_backward') AS causal_backward, count(*) FILTER (matching_mode = 'offline_interp') AS offline_interp,
count(*) FILTER (matching_mode = 'causal_backward') = count(*) FILTER (matching_mode = 'offline_interp') AS equal FROM fusion_height_aligned_samples WHERE err_u IS NOT NULL GROUP BY series"""


def q_missing_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-second cells of a flight in which one sensor was there and the other was not."""
    cell = F.floor(F.col("tr") / 10).alias("cell")
    keys = ["flight_id", "cell"]
    b, s = baro(spark, folder).select("flight_id", cell).distinct(), starlink(spark, folder).select("flight_id", cell).distinct()
    return b.join(s, keys, "left_anti").withColumn("lacks", F.lit("starlink")).unionByName(s.join(b, keys, "left_anti").withColumn("lacks", F.lit("baro")))


MISSING_SQL = with_sql("baro", "starlink", more="b AS (SELECT DISTINCT flight_id, CAST(floor(tr / 10) AS BIGINT) AS cell FROM baro), s AS (SELECT DISTINCT flight_id, CAST(floor(tr / 10) AS BIGINT) AS cell FROM starlink)") + (
    "SELECT flight_id, cell, 'starlink' AS lacks FROM b ANTI JOIN s USING (flight_id, cell) UNION ALL SELECT flight_id, cell, 'baro' FROM s ANTI JOIN b USING (flight_id, cell)"
)


def q_describe(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest of the flow size per flight."""
    f = flow(spark, folder)
    d = f.groupBy("flight_id").agg(F.count("flow_mag_filt").alias("n"), F.avg("flow_mag_filt").alias("mean"), F.stddev_samp("flow_mag_filt").alias("std"), F.min("flow_mag_filt").alias("lo"), F.max("flow_mag_filt").alias("hi"))
    q = exact_percentiles(f, KEY, "flow_mag_filt", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    return d.join(q, "flight_id").select("flight_id", "n", *map(r6, ("mean", "std", "lo", "q25", "q50", "q75", "hi")))


DESCRIBE_SQL = with_sql("flow") + (
    "SELECT flight_id, count(flow_mag_filt) AS n, round(avg(flow_mag_filt), 6) AS mean, round(stddev_samp(flow_mag_filt), 6) AS std, round(min(flow_mag_filt), 6) AS lo, round(quantile_cont(flow_mag_filt, 0.25), 6) AS q25, "
    "round(quantile_cont(flow_mag_filt, 0.5), 6) AS q50, round(quantile_cont(flow_mag_filt, 0.75), 6) AS q75, round(max(flow_mag_filt), 6) AS hi FROM flow GROUP BY flight_id"
)


def q_message_contract(spark: SparkSession, folder: str) -> DataFrame:
    """What is against the contract of a message, counted by topic: zero or missing stamp, stamp not after arrival, foreign frame, velocity not finite, turn rates not zero."""
    m = messages(spark, folder)
    codes = F.array_compact(
        F.array(
            F.when(F.coalesce("header_stamp_ns", F.lit(0)) == 0, "no_stamp"),
            F.when(F.col("header_stamp_ns") > F.col("bag_timestamp_ns"), "stamp_after_arrival"),
            F.when(F.coalesce("frame_id", F.lit("")) != "body_frd", "frame"),
            F.when(~(finite(F.col("lx")) & finite(F.col("ly")) & finite(F.col("lz"))), "not_finite"),
            F.when((F.abs("ax") > 1e-12) | (F.abs("ay") > 1e-12) | (F.abs("az") > 1e-12), "turning"),
        )
    )
    return m.select("topic", F.explode(codes).alias("code")).groupBy("topic", "code").agg(F.count("*").alias("n"))


CONTRACT_SQL = with_sql("messages", more="""c AS (SELECT topic, unnest([CASE WHEN coalesce(header_stamp_ns, 0) = 0 THEN 'no_stamp' END, CASE WHEN header_stamp_ns > bag_timestamp_ns THEN 'stamp_after_arrival' END,
  CASE WHEN coalesce(frame_id, '') <> 'body_frd' THEN 'frame' END, CASE WHEN NOT (coalesce(isfinite(lx), FALSE) AND coalesce(isfinite(ly), FALSE) AND coalesce(isfinite(lz), FALSE)) THEN 'not_finite' END,
  CASE WHEN abs(ax) > 1e-12 OR abs(ay) > 1e-12 OR abs(az) > 1e-12 THEN 'turning' END]) AS code FROM messages)""") + "SELECT topic, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL"


def q_message_time(spark: SparkSession, folder: str) -> DataFrame:
    """Time of a message (its stamp, else its arrival), in seconds and nanoseconds apart, by which it is, and a stamp that went through a double."""
    m = messages(spark, folder)
    use = F.coalesce(F.col("header_stamp_ns") > 0, F.lit(False))
    ns = F.when(use, F.col("header_stamp_ns")).otherwise(F.col("bag_timestamp_ns"))
    return m.select("rec_id", F.floor(ns / 1_000_000_000).alias("x"), ns.alias("ns"), F.when(use, "header").otherwise("bag").alias("source")).select(
        "rec_id", F.expr("ns div 1000000000").alias("sec"), F.expr("ns % 1000000000").alias("nanosec"), "source", F.col("ns").cast("double").cast("bigint").alias("through_double")
    )


MESSAGE_TIME_SQL = with_sql("messages", more="t AS (SELECT rec_id, CASE WHEN header_stamp_ns > 0 THEN header_stamp_ns ELSE bag_timestamp_ns END AS ns, CASE WHEN header_stamp_ns > 0 THEN 'header' ELSE 'bag' END AS source FROM messages)") + (
    "SELECT rec_id, ns // 1000000000 AS sec, ns % 1000000000 AS nanosec, source, CAST(CAST(ns AS DOUBLE) AS BIGINT) AS through_double FROM t"
)


def q_degree_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a stream's yaw is in degrees: its 99th percentile of size is above 7, or its greatest above 2 pi; two different rules."""
    e = table(spark, folder, "euler_raw").filter(finite(F.col("yaw"))).withColumn("size", F.abs("yaw"))
    p = exact_percentiles(e, ["flight_id", "origin"], "size", {"p99": 0.99, "top": 1.0})
    return p.select("flight_id", "origin", "n", F.round("p99", 4).alias("p99"), (F.col("p99") > 7).alias("by_p99"), (F.col("top") > 2 * math.pi + 0.1).alias("by_max"))


DEGREE_SQL = "SELECT flight_id, origin, count(*) AS n, round(quantile_cont(abs(yaw), 0.99), 4) AS p99, quantile_cont(abs(yaw), 0.99) > 7 AS by_p99, max(abs(yaw)) > 2 * pi() + 0.1 AS by_max FROM euler_raw WHERE isfinite(yaw) GROUP BY 1, 2"


def q_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each sparse fix as strict text (missing numbers as null), and the file name its source tag gives."""
    s = table(spark, folder, "starlink_corrected_enu")
    text = lambda c: F.coalesce(F.when(finite(F.col(c)), F.format_string("%.6f", F.col(c))), F.lit("null"))
    body = F.concat_ws(",", F.concat(F.lit("id="), F.col("fix_id").cast("string")), F.concat(F.lit("tr="), text("tr")), F.concat(F.lit("u="), text("u")))
    name = F.regexp_replace(F.regexp_replace(F.coalesce("t_source", F.lit("none")), r"[^A-Za-z0-9_]+", "_"), r"^_+", "")
    return s.select("fix_id", F.sha2(body, 256).alias("sha"), F.concat(name, F.lit(".csv")).alias("file"))


FINGERPRINT_SQL = """SELECT fix_id, sha256('id=' || fix_id || ',tr=' || coalesce(CASE WHEN isfinite(tr) THEN printf('%.6f', tr) END, 'null') || ',u=' || coalesce(CASE WHEN isfinite(u) THEN printf('%.6f', u) END, 'null')) AS sha,
regexp_replace(regexp_replace(coalesce(t_source, 'none'), '[^A-Za-z0-9_]+', '_', 'g'), '^_+', '') || '.csv' AS file FROM starlink_corrected_enu"""


def q_vision_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Vision rows per fused node (the last node at or before, 0.23 s old at most): nodes with none, one, more, and rows without a node."""
    n = table(spark, folder, "synthetic_gps_5hz_gtsam_fixedlag").filter(finite(F.col("tr"))).groupBy("flight_id", "tr").agg(F.min("idx").alias("idx"))
    v = asof(vision(spark, folder).select("flight_id", "sample_id", "tr"), n, KEY, "tr", ["idx"], tolerance=0.23)
    used = v.groupBy("flight_id", "idx").agg(F.count("*").alias("k"))
    a = used.groupBy("flight_id").agg(F.count_if(F.col("idx").isNotNull()).alias("nodes_used"), F.count_if(F.col("idx").isNotNull() & (F.col("k") > 1)).alias("nodes_shared"), F.coalesce(F.sum(F.when(F.col("idx").isNull(), F.col("k"))), F.lit(0)).alias("rows_without"))
    return n.groupBy("flight_id").agg(F.count("*").alias("nodes")).join(a, "flight_id")


COVERAGE_SQL = with_sql("vision", more="""n AS (SELECT flight_id, tr, min(idx) AS idx FROM synthetic_gps_5hz_gtsam_fixedlag WHERE isfinite(tr) GROUP BY 1, 2),
v AS (SELECT v.flight_id, CASE WHEN v.tr - n.tr <= 0.23 THEN idx END AS idx FROM vision v ASOF LEFT JOIN n ON v.flight_id = n.flight_id AND v.tr >= n.tr), k AS (SELECT flight_id, idx, count(*) AS k FROM v GROUP BY 1, 2)""") + (
    "SELECT flight_id, nodes, count(*) FILTER (idx IS NOT NULL) AS nodes_used, count(*) FILTER (idx IS NOT NULL AND k > 1) AS nodes_shared, CAST(coalesce(sum(k) FILTER (idx IS NULL), 0) AS BIGINT) AS rows_without "
    "FROM k JOIN (SELECT flight_id, count(*) AS nodes FROM n GROUP BY 1) USING (flight_id) GROUP BY 1, 2"
)

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
SQL = {
    "q_robust_sigma": SIGMA_SQL,
    "q_node_bins": NODE_SQL,
    "q_node_flush": FLUSH_SQL,
    "q_linear_fit": FIT_SQL,
    "q_speed_split": SPLIT_SQL,
    "q_geo_enu": GEO_SQL,
    "q_geo_round_trip": ROUND_TRIP_SQL,
    "q_origin": ORIGIN_SQL,
    "q_baro_offset": OFFSET_SQL,
    "q_starlink_quality": STARLINK_SQL,
    "q_time_ranges": RANGES_SQL,
    "q_topk_errors": TOPK_SQL,
    "q_pivot_counts": PIVOT_SQL,
    "q_missing_anti": MISSING_SQL,
    "q_describe": DESCRIBE_SQL,
    "q_message_contract": CONTRACT_SQL,
    "q_message_time": MESSAGE_TIME_SQL,
    "q_degree_scale": DEGREE_SQL,
    "q_fingerprint": FINGERPRINT_SQL,
    "q_vision_coverage": COVERAGE_SQL,
}
