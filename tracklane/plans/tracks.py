"""Queries of fused tracks and prepared heights: position errors, filters that start anew, replay by windows, gyro compensation, field errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions import motion
from tracklane.functions.missing import finite
from tracklane.operators.align import asof, interpolate
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, last_known, owned, running_sum
from tracklane.operators.joins import join_checked
from tracklane.operators.recurrence import exponential_gain, low_pass, rational_gain
from tracklane.plans.alignment import DELAY_SQL, KEY, q_delay_scan, r6
from tracklane.plans.calibration import ENU_OFFSET_SQL, FX, FY, q_enu_offset
from tracklane.plans.problems import FLOW_FIELDS, TWIST_FIELDS
from tracklane.plans.statistics import STARLINK_SQL, q_starlink_quality
from tracklane.plans.validation import BLOCKS, MOTION_SQL, q_motion_start
from tracklane.session import cut
from tracklane.sources.sensors import attitude, baro, flow, gps, one_per_key, starlink, vision, with_sql
from tracklane.sources.tables import table

WIN, TAU = 11, 0.8  # rows of the trailing median and mean, seconds of the low-pass
SETTLE = 10.0  # seconds after the first height and fix from which heights are used
LAG = 20.0


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Fused nodes with a time and a position, the first emitted of each time."""
    n = table(spark, folder, "synthetic_gps_5hz_gtsam_fixedlag")
    n = n.filter(finite(F.col("tr")) & finite(F.col("e")) & finite(F.col("n")) & finite(F.col("u")))
    return one_per_key(n.select("flight_id", "tr", "idx", "seg", "e", "n", "u", "vu"), ["flight_id", "tr"], "idx", "u")


NODES = """nodes AS (SELECT flight_id, tr, idx, seg, e, n, u, vu FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, tr ORDER BY idx, u) AS rn
  FROM synthetic_gps_5hz_gtsam_fixedlag WHERE isfinite(tr) AND isfinite(e) AND isfinite(n) AND isfinite(u)) WHERE rn = 1)"""


def q_position_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Fused track against the dense fixes, each with the node before it, while the track lasts: errors per axis, horizontal (with 95th percentile) and in space."""
    n = nodes(spark, folder)
    span = cut(n.groupBy("flight_id").agg(F.max("tr").alias("end")))
    g = gps(spark, folder).select("flight_id", "tr", *(F.col(c).alias(f"{c}0") for c in "enu"))
    d = asof(g, n.select("flight_id", "tr", "e", "n", "u"), KEY, "tr", ["e", "n", "u"]).filter("e IS NOT NULL")
    d = join_checked(d, span, KEY).filter("tr <= end").select("flight_id", *((F.col(c) - F.col(f"{c}0")).alias(f"d{c}") for c in "enu"))
    d = d.withColumn("xy", F.hypot("de", "dn"))
    square = lambda *cs: F.sqrt(F.avg(sum((F.col(c) ** 2 for c in cs), F.lit(0.0))))
    figures = [(F.sqrt(F.avg(F.col(f"d{c}") ** 2)), f"rmse_{c}") for c in "enu"] + [(F.avg(F.abs(f"d{c}")), f"mae_{c}") for c in "enu"] + [(F.max(F.abs(f"d{c}")), f"max_{c}") for c in "enu"]
    figures += [(square("xy"), "rmse_xy"), (F.avg("xy"), "mae_xy"), (F.max("xy"), "max_xy"), (square("xy", "du"), "rmse_3d")]
    out = d.groupBy("flight_id").agg(F.count("*").alias("fixes"), *(F.round(c, 5).alias(a) for c, a in figures)).filter("fixes >= 2")
    tail = exact_percentiles(d, KEY, "xy", {"p95": 0.95}).select("flight_id", F.round("p95", 5).alias("p95_xy"))
    return out.join(tail, "flight_id")


POSITION_SQL = with_sql("gps", more=NODES + """, s AS (SELECT flight_id, max(tr) AS fin FROM nodes GROUP BY 1),
d AS (SELECT g.flight_id, x.e - g.e AS de, x.n - g.n AS dn, x.u - g.u AS du FROM gps g ASOF JOIN nodes x ON g.flight_id = x.flight_id AND g.tr >= x.tr JOIN s ON s.flight_id = g.flight_id AND g.tr <= s.fin)""") + (
    "SELECT flight_id, count(*) AS fixes, "
    + ", ".join(f"round(sqrt(avg(d{c} ** 2)), 5) AS rmse_{c}, round(avg(abs(d{c})), 5) AS mae_{c}, round(max(abs(d{c})), 5) AS max_{c}" for c in "enu")
    + ", round(sqrt(avg(de ** 2 + dn ** 2)), 5) AS rmse_xy, round(avg(sqrt(de ** 2 + dn ** 2)), 5) AS mae_xy, round(max(sqrt(de ** 2 + dn ** 2)), 5) AS max_xy, "
    "round(sqrt(avg(de ** 2 + dn ** 2 + du ** 2)), 5) AS rmse_3d, round(quantile_cont(sqrt(de ** 2 + dn ** 2), 0.95), 5) AS p95_xy FROM d GROUP BY 1 HAVING count(*) >= 2"
)


def smoothed(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the trailing median, of these the trailing mean, of ``value`` by tr."""
    d = in_blocks(df, keys, ["tr"], F.floor(F.col("tr") / 600), 2 * (WIN - 1), 0)
    w = block_window(keys).rowsBetween(1 - WIN, 0)
    return owned(d.withColumn("_med", F.percentile(value, 0.5).over(w)).withColumn(name, F.avg("_med").over(w))).drop("_med", "pos")


def _smoothed_sql(source: str, keys: str, value: str, columns: str) -> str:
    """Tables md and sm (with column b) of a table ``source``."""
    w = f"(PARTITION BY {keys} ORDER BY tr ROWS BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW)"
    return f"md AS (SELECT {columns}, quantile_cont({value}, 0.5) OVER {w} AS med FROM {source}), sm AS (SELECT *, avg(med) OVER {w} AS b FROM md)"


def _filtered_sql(keys: list[str], seed: str, step: str = f"(1 - exp(-(s.tr - r.tr) / {TAU}))") -> str:
    """Table f: sm with y, its column b low-passed along tr, beginning with ``seed``."""
    by, on = ", ".join(keys), " AND ".join(f"s.{k} = r.{k}" for k in keys)
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY tr) AS i FROM sm),
f AS (SELECT s.*, {seed} AS y FROM s WHERE i = 1 UNION ALL SELECT s.*, r.y + {step} * (s.b - r.y) FROM f r JOIN s ON {on} AND s.i = r.i + 1)"""


def q_smooth_export(spark: SparkSession, folder: str) -> DataFrame:
    """Fused heights for export: trailing median and mean, then the low-pass, in place of the raw height, which is kept beside; climb by the trailing mean of what there is."""
    d = smoothed(nodes(spark, folder).select("flight_id", "tr", "idx", "u", "vu"), KEY, "u", "b")
    d = low_pass(d, KEY, "tr", ["idx"], "b", exponential_gain(TAU))
    d = in_blocks(d.withColumn("vu", F.when(finite(F.col("vu")), F.col("vu"))), KEY, ["tr"], F.floor(F.col("tr") / 600), WIN - 1, 0)
    d = owned(d.withColumn("climb", F.avg("vu").over(block_window(KEY).rowsBetween(1 - WIN, 0))))
    return d.select("flight_id", "idx", F.round("y", 5).alias("u"), (F.round("climb", 5) + 0.0).alias("vu"), F.round("u", 5).alias("u_raw"), (F.round("vu", 5) + 0.0).alias("vu_raw"))


EXPORT_SQL = f"WITH RECURSIVE {NODES}, {_smoothed_sql('nodes', 'flight_id', 'u', 'flight_id, tr, idx, u, CASE WHEN isfinite(vu) THEN vu END AS vu')}, {_filtered_sql(KEY, 's.b')}" + f"""
SELECT flight_id, idx, round(y, 5) AS u, round(avg(vu) OVER (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW), 5) + 0.0 AS vu, round(u, 5) AS u_raw, round(vu, 5) + 0.0 AS vu_raw FROM f"""


def _anchor(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Barometer heights, and per flight its start, and the last height and reference at or before it (t0, u0, p0)."""
    b, g = baro(spark, folder).select("flight_id", "tr", "u"), gps(spark, folder).select("flight_id", "tr", "u")
    first = lambda d, c: d.groupBy("flight_id").agg(F.min("tr").alias(c))
    start = cut(first(b, "x").join(first(g, "y"), "flight_id").select("flight_id", (F.greatest("x", "y") + SETTLE).alias("start")))
    last = lambda d: join_checked(d, start, KEY, "inner").filter("tr <= start").groupBy("flight_id", "start").agg(F.max(F.struct("tr", "u")).alias("r"))
    ref = last(g).select("flight_id", F.col("r.u").alias("p0"))
    return b, cut(last(b).join(ref, "flight_id").select("flight_id", "start", F.col("r.tr").alias("t0"), F.col("r.u").alias("u0"), "p0"))


def q_alignment_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Heights set to the reference at a start (10 s after the first height and fix) in two ways: filtered over all their history and moved by the filtered height there; or moved by the raw height there and filtered anew from it on, beginning with the reference. Offsets, and RMSE against the reference before each height from the start on."""
    b, anchor = _anchor(spark, folder)
    whole = low_pass(smoothed(b, KEY, "u", "b"), KEY, "tr", [], "b", exponential_gain(TAU))
    at = join_checked(whole, anchor, KEY, "inner").filter("tr = t0").select("flight_id", (F.col("p0") - F.col("y")).alias("filtered_offset"))
    anchor = cut(anchor.join(at, "flight_id"))
    one = join_checked(whole, anchor, KEY, "inner").filter(F.col("tr") >= F.col("start")).select("flight_id", "tr", F.col("y").alias("y"), F.col("filtered_offset").alias("o"), F.lit("filtered").alias("way"))
    # a filter that begins with p0 over heights moved by p0 - u0 is one that begins with 0 over heights less u0
    anew = join_checked(b, anchor, KEY, "inner").filter("tr >= t0").withColumn("u", F.col("u") - F.col("u0")).select("flight_id", "tr", "u")
    anew = low_pass(smoothed(anew, KEY, "u", "b"), KEY, "tr", [], "b", exponential_gain(TAU), seed=0.0)
    two = join_checked(anew, anchor, KEY, "inner").filter(F.col("tr") >= F.col("start")).select("flight_id", "tr", F.col("y").alias("y"), F.col("p0").alias("o"), F.lit("raw").alias("way"))
    g = gps(spark, folder).select("flight_id", "tr", F.col("u").alias("ref"))
    d = asof(one.unionByName(two), g, KEY, "tr", ["ref"]).filter("ref IS NOT NULL").withColumn("err", F.col("y") + F.col("o") - F.col("ref"))
    rms = lambda way: F.round(F.sqrt(F.avg(F.when(F.col("way") == way, F.col("err") ** 2))), 5)
    d = d.groupBy("flight_id").agg(F.count_if(F.col("way") == "raw").alias("n"), rms("filtered").alias("filtered_rmse"), rms("raw").alias("raw_rmse"))
    return join_checked(d, anchor, KEY).select("flight_id", "n", F.round("filtered_offset", 5).alias("filtered_offset"), F.round(F.col("p0") - F.col("u0"), 5).alias("raw_offset"), "filtered_rmse", "raw_rmse")


_START_SQL = f"""st AS (SELECT flight_id, greatest(x, y) + {SETTLE} AS start FROM (SELECT flight_id, min(tr) AS x FROM baro GROUP BY 1) JOIN (SELECT flight_id, min(tr) AS y FROM gps GROUP BY 1) USING (flight_id)),
la AS (SELECT flight_id, start, max(tr) AS t0, arg_max(u, tr) AS u0 FROM baro JOIN st USING (flight_id) WHERE tr <= start GROUP BY 1, 2), rf AS (SELECT flight_id, arg_max(u, tr) AS p0 FROM gps JOIN st USING (flight_id) WHERE tr <= start GROUP BY 1),
an AS (SELECT * FROM la JOIN rf USING (flight_id))"""
ALIGN_SQL = f"""WITH one AS (WITH RECURSIVE {with_sql("baro")[5:].rstrip()}, {_smoothed_sql("baro", "flight_id", "u", "flight_id, tr, u")}, {_filtered_sql(KEY, "s.b")} SELECT flight_id, tr, y FROM f),
two AS (WITH RECURSIVE {with_sql("baro", "gps", more=_START_SQL)[5:].rstrip()}, bb AS (SELECT b.flight_id, b.tr, b.u + p0 - u0 AS u, p0 FROM baro b JOIN an USING (flight_id) WHERE b.tr >= t0),
{_smoothed_sql("bb", "flight_id", "u", "flight_id, tr, u, p0")}, {_filtered_sql(KEY, "s.p0")} SELECT flight_id, tr, y FROM f),
{with_sql("baro", "gps", more=_START_SQL)[5:].rstrip()}, o AS (SELECT an.*, p0 - one.y AS fo FROM an JOIN one ON one.flight_id = an.flight_id AND one.tr = t0),
b AS (SELECT one.flight_id, one.tr, one.y + fo AS y, 'filtered' AS way FROM one JOIN o USING (flight_id) WHERE one.tr >= start UNION ALL SELECT two.flight_id, two.tr, two.y, 'raw' FROM two JOIN o USING (flight_id) WHERE two.tr >= start),
e AS (SELECT b.flight_id, way, b.y - g.u AS err FROM b ASOF JOIN gps g ON b.flight_id = g.flight_id AND b.tr >= g.tr),
q AS (SELECT flight_id, count(*) FILTER (way = 'raw') AS n, round(sqrt(avg(err ** 2) FILTER (way = 'filtered')), 5) AS filtered_rmse, round(sqrt(avg(err ** 2) FILTER (way = 'raw')), 5) AS raw_rmse FROM e GROUP BY 1)
SELECT flight_id, n, round(fo, 5) AS filtered_offset, round(p0 - u0, 5) AS raw_offset, filtered_rmse, raw_rmse FROM q JOIN o USING (flight_id)"""


def q_replay_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Heights filtered anew in every window of the blocked validation, nothing carried from before it: rows, and the filtered height at its end, per flight and window."""
    blocks = spark.createDataFrame([b[:3] for b in BLOCKS], "win string, a double, duration double")
    b = baro(spark, folder).select("flight_id", "tr", "u").join(F.broadcast(blocks), F.col("tr").between(F.col("a"), F.col("a") + F.col("duration")))  # ten rows
    keys = ["flight_id", "win"]
    d = low_pass(smoothed(b.select(*keys, "tr", "u"), keys, "u", "b"), keys, "tr", [], "b", exponential_gain(TAU))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.max(F.struct("tr", "y"))["y"], 5).alias("last"), F.round(F.avg("y"), 5).alias("mean"))


REPLAY_SQL = f"""WITH RECURSIVE {with_sql("baro")[5:].rstrip()}, bl AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {o}, {d})" for n, o, d, _ in BLOCKS)}) v(win, lo, duration)),
w AS (SELECT flight_id, win, tr, u FROM baro JOIN bl ON tr BETWEEN lo AND lo + duration), {_smoothed_sql("w", "flight_id, win", "u", "flight_id, win, tr, u")}, {_filtered_sql(["flight_id", "win"], "s.b")}
SELECT flight_id, win, count(*) AS n, round(arg_max(y, tr), 5) AS last, round(avg(y), 5) AS mean FROM f GROUP BY 1, 2"""


def q_strides(spark: SparkSession, folder: str) -> DataFrame:
    """Which measurements a node of the 5 Hz track takes: an attitude every fifth, a barometer height (the last at or before it, while the barometer lasts) every second."""
    n = nodes(spark, folder).select("flight_id", "tr", "idx")
    b = baro(spark, folder).select("flight_id", "tr", F.col("u").alias("z"))
    ends = cut(b.groupBy("flight_id").agg(F.max("tr").alias("end")))
    d = join_checked(asof(n, b, KEY, "tr", ["z"]), ends, KEY)
    z = F.when((F.col("idx") % 2 == 0) & (F.col("tr") <= F.col("end")), F.col("z"))
    d = d.withColumn("z", z).withColumn("ahrs", F.col("idx") % 5 == 0).filter("ahrs OR z IS NOT NULL")
    return d.select("flight_id", "idx", r6("tr"), "ahrs", F.round("z", 6).alias("z"))


STRIDES_SQL = with_sql("baro", more=NODES + """, e AS (SELECT flight_id, max(tr) AS fin FROM baro GROUP BY 1),
j AS (SELECT x.flight_id, x.idx, x.tr, x.idx % 5 = 0 AS ahrs, CASE WHEN x.idx % 2 = 0 AND x.tr <= fin THEN b.u END AS z FROM nodes x ASOF LEFT JOIN baro b ON x.flight_id = b.flight_id AND x.tr >= b.tr LEFT JOIN e ON e.flight_id = x.flight_id)""") + (
    "SELECT flight_id, idx, round(tr, 6) AS tr, ahrs, round(z, 6) AS z FROM j WHERE ahrs OR z IS NOT NULL"
)


def q_finality(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that left the smoother's lag before the track ended, and those still in it at the end, per flight and stretch of log."""
    n = nodes(spark, folder)
    end = cut(n.groupBy("flight_id", "seg").agg(F.max("tr").alias("end")))
    kind = F.when(F.col("tr") < F.col("end") - LAG, "fixed_lag_final").otherwise("tail_final")
    d = join_checked(n, end, ["flight_id", "seg"]).groupBy("flight_id", "seg", kind.alias("source"))
    return d.agg(F.count("*").alias("n"), F.round(F.min("tr"), 6).alias("first"), F.round(F.max("tr"), 6).alias("last"))


FINALITY_SQL = f"""WITH {NODES}, k AS (SELECT flight_id, seg, tr, CASE WHEN tr < max(tr) OVER (PARTITION BY flight_id, seg) - {LAG} THEN 'fixed_lag_final' ELSE 'tail_final' END AS source FROM nodes)
SELECT flight_id, seg, source, count(*) AS n, round(min(tr), 6) AS "first", round(max(tr), 6) AS "last" FROM k GROUP BY 1, 2, 3"""


def q_active_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The time that fixes, barometer and vision of a flight cover, from 2 s before it moves on."""
    spans = [d.groupBy("flight_id").agg(F.min("tr").alias("a"), F.max("tr").alias("b")) for d in (gps(spark, folder), baro(spark, folder), vision(spark, folder))]
    both = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy("flight_id").agg(F.count("*").alias("n"), F.max("a").alias("a"), F.min("b").alias("b")).filter("n = 3")
    moves = q_motion_start(spark, folder).withColumnRenamed("start", "moves")
    d = both.join(moves, "flight_id", "left").withColumn("start", F.greatest("a", F.col("moves") - 2))
    return d.select("flight_id", r6("start"), F.round("b", 6).alias("end"), (F.col("start") < F.col("b")).alias("active"))


INTERVAL_SQL = f"""WITH mv AS ({MOTION_SQL}), {with_sql("gps", "baro", "vision")[5:].rstrip()},
s AS (SELECT flight_id, min(tr) AS a, max(tr) AS b FROM gps GROUP BY 1 UNION ALL SELECT flight_id, min(tr), max(tr) FROM baro GROUP BY 1 UNION ALL SELECT flight_id, min(tr), max(tr) FROM vision GROUP BY 1),
u AS (SELECT flight_id, max(a) AS a, min(b) AS b FROM s GROUP BY 1 HAVING count(*) = 3)
SELECT flight_id, round(greatest(a, coalesce(mv.start - 2, a)), 6) AS start, round(b, 6) AS "end", greatest(a, coalesce(mv.start - 2, a)) < b AS active FROM u LEFT JOIN mv USING (flight_id)"""


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Angles turned about x and y since the flight began: the running integral of the rates by trapezoids, first row of each time."""
    v = table(spark, folder, "vision_velocity_corrected_frd").filter(finite(F.col("tr")) & finite(F.col("wx")) & finite(F.col("wy")))
    v = one_per_key(v.select("flight_id", "tr", "sample_id", "wx", "wy"), ["flight_id", "tr"], "sample_id")
    d = in_blocks(v.drop("sample_id"), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 0)
    w = block_window(KEY)
    area = lambda c: F.coalesce(0.5 * (F.col("tr") - F.lag("tr").over(w)) * (F.col(c) + F.lag(c).over(w)), F.lit(0.0))
    d = owned(d.withColumns({"ax": area("wx"), "ay": area("wy")}))
    return running_sum(d, KEY, {"gx": F.col("ax"), "gy": F.col("ay")}).select("flight_id", "tr", "gx", "gy")


def q_gyro_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Flow frames as velocities over ground, less what the turning of the body explains: the integral of its rates read at the frame's begin and end; barometer height interpolated at the end; from camera axes (right, down) to body axes (forward, right)."""
    f = flow(spark, folder).filter("t_sec IS NOT NULL AND dt_s > 0").select("flight_id", "frame_idx", F.col("t_sec").alias("end"), (F.col("t_sec") - F.col("dt_s")).alias("begin"), "dt_s", "flow_x_px_s_filt", "flow_y_px_s_filt")
    g = _turns(spark, folder)
    d = interpolate(f.withColumnRenamed("begin", "tr"), g, KEY, "tr", ["gx", "gy"]).withColumnsRenamed({"gx_at": "x0", "gy_at": "y0"}).drop("tr")
    d = interpolate(d.withColumnRenamed("end", "tr"), g, KEY, "tr", ["gx", "gy"])
    d = interpolate(d, baro(spark, folder).select("flight_id", "tr", "u"), KEY, "tr", ["u"])
    # camera x is to the right of the body, camera y behind it: turning about body x and y is about camera x as -y and camera y as x
    body = [F.col("gx_at") - F.col("x0"), F.col("gy_at") - F.col("y0")]
    camera = motion.turn([*body, F.lit(0.0)], [[0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    rx, ry = motion.angular_flow(F.col("flow_x_px_s_filt") * F.col("dt_s"), F.col("flow_y_px_s_filt") * F.col("dt_s"), F.col("dt_s"), FX, FY, camera)
    vx, vy = motion.metric_velocity(rx, ry, F.col("u_at"))
    forward, right, _ = motion.turn([vx, vy, F.lit(0.0)], [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return d.select("flight_id", "frame_idx", F.round(forward, 5).alias("forward"), F.round(right, 5).alias("right"))


_LINE = "CASE WHEN q{n}.tr IS NULL THEN CASE WHEN p{n}.tr = {t} THEN p{n}.{c} END ELSE p{n}.{c} + (q{n}.{c} - p{n}.{c}) * (({t} - p{n}.tr) / (q{n}.tr - p{n}.tr)) END"
GYRO_SQL = with_sql("flow", "baro", more="""w AS (SELECT flight_id, tr, wx, wy FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, tr ORDER BY sample_id) AS rn FROM vision_velocity_corrected_frd WHERE isfinite(tr) AND isfinite(wx) AND isfinite(wy)) WHERE rn = 1),
a AS (SELECT flight_id, tr, coalesce(0.5 * (tr - lag(tr) OVER k) * (wx + lag(wx) OVER k), 0) AS ax, coalesce(0.5 * (tr - lag(tr) OVER k) * (wy + lag(wy) OVER k), 0) AS ay FROM w WINDOW k AS (PARTITION BY flight_id ORDER BY tr)),
g AS (SELECT flight_id, tr, sum(ax) OVER k AS gx, sum(ay) OVER k AS gy FROM a WINDOW k AS (PARTITION BY flight_id ORDER BY tr ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, t_sec - dt_s AS t0 FROM flow WHERE t_sec IS NOT NULL AND dt_s > 0),
j AS (SELECT f.*, """ + ", ".join(_LINE.format(n=n, c=c, t=t) + f" AS {a}" for n, c, t, a in ((1, "gx", "f.t0", "x0"), (1, "gy", "f.t0", "y0"), (2, "gx", "f.t_sec", "x1"), (2, "gy", "f.t_sec", "y1"), (3, "u", "f.t_sec", "u"))) + """ FROM f
  ASOF LEFT JOIN g p1 ON f.flight_id = p1.flight_id AND f.t0 >= p1.tr ASOF LEFT JOIN g q1 ON f.flight_id = q1.flight_id AND f.t0 < q1.tr
  ASOF LEFT JOIN g p2 ON f.flight_id = p2.flight_id AND f.t_sec >= p2.tr ASOF LEFT JOIN g q2 ON f.flight_id = q2.flight_id AND f.t_sec < q2.tr
  ASOF LEFT JOIN baro p3 ON f.flight_id = p3.flight_id AND f.t_sec >= p3.tr ASOF LEFT JOIN baro q3 ON f.flight_id = q3.flight_id AND f.t_sec < q3.tr)""") + (
    f"SELECT flight_id, frame_idx, round(u * ((flow_y_px_s_filt * dt_s / {FY} - (y1 - y0)) / dt_s), 5) AS forward, round(-u * ((flow_x_px_s_filt * dt_s / {FX} - (x1 - x0)) / dt_s), 5) AS \"right\" FROM j"
)


def q_ray_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Heights as distances for flow: along the ray as measured, the vertical part of it, and a vertical height turned into one along the ray, by the attitude (of every unit) interpolated at their time; none near the horizon."""
    b = baro(spark, folder).select("flight_id", "sample_id", "tr", "u")
    d = interpolate(b, attitude(spark, folder, "roll", "pitch").select("flight_id", "tr", "roll", "pitch"), KEY, "tr", ["roll", "pitch"])
    modes = [F.round(motion.distance_to_ground(F.col("u"), F.col("roll_at"), F.col("pitch_at"), m), 5).alias(m) for m in ("ray", "vertical", "vertical_to_ray")]
    return d.select("flight_id", "sample_id", *modes)


def q_hold_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Flow with bad frames held and decaying, then low-passed at 1 Hz from zero; a frame that takes no time is taken as it is."""
    f = flow(spark, folder).filter("t_sec IS NOT NULL").select("flight_id", "frame_idx", F.col("t_sec").alias("t"), F.col("flow_x_px_s_filt").alias("x"), (F.coalesce("is_bad_measurement", F.lit(1.0)) > 0).alias("bad"))
    d = last_known(f, KEY, ["t", "frame_idx"], F.when(~F.col("bad") & F.col("x").isNotNull(), F.struct("t", "x")), "g")
    held = F.col("t") - F.col("g.t")
    d = d.withColumn("v", F.coalesce(F.when(held <= 0.5, F.col("g.x")).otherwise(F.col("g.x") * F.exp(-(held - 0.5) / 0.5)), F.lit(0.0))).drop("g", "x", "bad")
    tau = 1 / (2 * math.pi)
    out = low_pass(d, KEY, "t", ["frame_idx"], "v", lambda dt: F.when(dt > 0, dt / (tau + dt)).otherwise(1.0), seed=0.0)
    return out.select("flight_id", "frame_idx", F.round("y", 5).alias("y"))


HOLD_FILTERED_SQL = "WITH RECURSIVE " + with_sql("flow")[5:].rstrip() + f""", h0 AS (SELECT flight_id, frame_idx, t_sec AS t, flow_x_px_s_filt AS x, coalesce(is_bad_measurement, 1) <= 0 AND flow_x_px_s_filt IS NOT NULL AS ok FROM flow WHERE t_sec IS NOT NULL),
h1 AS (SELECT *, last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER k AS gt, last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER k AS gx FROM h0 WINDOW k AS (PARTITION BY flight_id ORDER BY t, frame_idx ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT flight_id, frame_idx, t AS tr, coalesce(CASE WHEN t - gt <= 0.5 THEN gx ELSE gx * exp(-(t - gt - 0.5) / 0.5) END, 0) AS b FROM h1),
s AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY tr, frame_idx) AS i FROM sm),
f AS (SELECT s.*, s.b AS y FROM s WHERE i = 1 UNION ALL SELECT s.*, r.y + CASE WHEN s.tr > r.tr THEN (s.tr - r.tr) / ({1 / (2 * math.pi)} + (s.tr - r.tr)) ELSE 1 END * (s.b - r.y) FROM f r JOIN s ON s.flight_id = r.flight_id AND s.i = r.i + 1)
SELECT flight_id, frame_idx, round(y, 5) AS y FROM f"""


def q_iir_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """Vision vx low-passed with gain dt / (0.25 + dt), dt of a tenth of a millisecond at least; gaps hold."""
    v = table(spark, folder, "vision_velocity_corrected_frd").filter(finite(F.col("tr"))).select("flight_id", "tr", "sample_id", F.when(finite(F.col("vx")), F.col("vx")).alias("x"))
    out = low_pass(v, KEY, "tr", ["sample_id"], "x", rational_gain(0.25))
    return out.select("flight_id", "sample_id", F.round("y", 5).alias("y"))


BY_TIME_SQL = """WITH RECURSIVE sm AS (SELECT flight_id, tr, sample_id, CASE WHEN isfinite(vx) THEN vx END AS x FROM vision_velocity_corrected_frd WHERE isfinite(tr)),
s AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY tr, sample_id) AS i FROM sm),
f AS (SELECT s.*, s.x AS y FROM s WHERE i = 1 UNION ALL SELECT s.*, CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x ELSE r.y + greatest(1e-4, s.tr - r.tr) / (0.25 + greatest(1e-4, s.tr - r.tr)) * (s.x - r.y) END
  FROM f r JOIN s ON s.flight_id = r.flight_id AND s.i = r.i + 1)
SELECT flight_id, sample_id, round(y, 5) AS y FROM f"""

_COPIES = (
    ("flow", "lk_flow_physical_filtered", "lk_flow_golden", "frame_idx", [f.path for f in FLOW_FIELDS if f.kind == "number"]),
    ("twist", "decoded_record", "twist_golden", "msg_seq", [f.path for f in TWIST_FIELDS if f.kind == "number"]),
)
TOLERANCE = 0.001


def q_field_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The two copies field by field, over the keys that both hold: absolute errors of finite pairs, and pairs that are both missing or infinite alike, or only one so; repeated rows of a key are one row, by the least value of a field."""
    out = None
    for name, a, b, key, fields in _COPIES:
        one = lambda t, s: table(spark, folder, t).groupBy("flight_id", F.col(key).alias("k")).agg(*(F.min(f).alias(f"{s}{i}") for i, f in enumerate(fields)))  # noqa: B023, E731
        j = one(a, "a").join(one(b, "b"), ["flight_id", "k"])
        pairs = j.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a{i}").cast("double").alias("a"), F.col(f"b{i}").cast("double").alias("b")) for i, f in enumerate(fields)))).alias("p")).select("p.*")
        x, y = (F.coalesce(F.col(c), F.lit(float("nan"))) for c in "ab")
        both = finite(x) & finite(y)
        err = F.when(both, F.abs(x - y))
        alike = ~both & ((F.isnan(x) & F.isnan(y)) | (x == y))
        part = pairs.groupBy("field").agg(
            F.count("*").alias("pairs"), F.count(err).alias("finite_pairs"), F.count_if(alike).alias("missing_alike"), F.count_if(~both & ~alike).alias("missing_in_one"),
            F.count_if(alike | F.coalesce(err == 0, F.lit(False))).alias("exact"), F.count_if(alike | F.coalesce(err <= TOLERANCE, F.lit(False))).alias("within"),
            F.round(F.min(err), 6).alias("least"), F.round(F.max(err), 6).alias("most"), F.round(F.avg(err), 6).alias("mean"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rms"),
        ).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _errors_sql() -> str:
    parts = []
    for name, a, b, key, fields in _COPIES:
        for f in fields:
            parts.append(f"""SELECT '{name}' AS dataset, '{f}' AS field, coalesce(x.v, 'nan'::DOUBLE) AS a, coalesce(y.v, 'nan'::DOUBLE) AS b FROM (SELECT flight_id, {key} AS k, min(CAST({f} AS DOUBLE)) AS v FROM {a} GROUP BY 1, 2) x
  JOIN (SELECT flight_id, {key} AS k, min(CAST({f} AS DOUBLE)) AS v FROM {b} GROUP BY 1, 2) y USING (flight_id, k)""")
    return f"""WITH p AS ({" UNION ALL ".join(parts)}), q AS (SELECT *, CASE WHEN isfinite(a) AND isfinite(b) THEN abs(a - b) END AS err, NOT (isfinite(a) AND isfinite(b)) AND (isnan(a) AND isnan(b) OR a = b) AS alike FROM p)
SELECT dataset, field, count(*) AS pairs, count(err) AS finite_pairs, count(*) FILTER (alike) AS missing_alike, count(*) FILTER (err IS NULL AND NOT alike) AS missing_in_one, count(*) FILTER (alike OR err = 0) AS exact,
count(*) FILTER (alike OR err <= {TOLERANCE}) AS within, round(min(err), 6) AS least, round(max(err), 6) AS most, round(avg(err), 6) AS mean, round(sqrt(avg(err * err)), 6) AS rms FROM q GROUP BY 1, 2"""


def q_zero_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of a message that must be zero (turn rates, climb), over all log entries: how many are not finite or beyond 1e-12, the largest, and whether the rule holds."""
    m = table(spark, folder, "decoded_record")
    names = ("angular.x", "angular.y", "angular.z", "linear.z")
    d = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("v")) for n in names))).alias("p")).select("p.*")
    ok = finite(F.col("v"))
    out = d.groupBy("field").agg(F.count("*").alias("n"), F.count_if(~ok).alias("not_finite"), F.count_if(ok & (F.abs("v") > 1e-12)).alias("beyond"), F.max(F.when(ok, F.abs("v"))).alias("most"))
    return out.withColumn("valid", (F.col("not_finite") == 0) & (F.col("beyond") == 0))


ZERO_SQL = f"""WITH p AS ({" UNION ALL ".join(f"SELECT '{n}' AS field, {n} AS v FROM decoded_record" for n in ("angular.x", "angular.y", "angular.z", "linear.z"))}), q AS (SELECT *, coalesce(isfinite(v), FALSE) AS ok FROM p)
SELECT field, count(*) AS n, count(*) FILTER (NOT ok) AS not_finite, count(*) FILTER (ok AND abs(v) > 1e-12) AS beyond, max(abs(v)) FILTER (ok) AS most, count(*) FILTER (NOT ok) = 0 AND count(*) FILTER (ok AND abs(v) > 1e-12) = 0 AS valid FROM q GROUP BY 1"""

LIMITS = motion.physical_limits(384, 288, 40.0, 100.0, 60.0, 30.0)
_BEYOND = (("flow_x_px_s_filt", "flow_x"), ("flow_y_px_s_filt", "flow_y"), ("dx_px_filt_equiv", "dx"), ("dy_px_filt_equiv", "dy"))


def q_physical_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Flow frames faster than the camera could see the ground move from 100 m at 60 m/s, per second or per frame; missing numbers are beyond any limit."""
    f = table(spark, folder, "lk_flow_physical_filtered").groupBy("flight_id", "frame_idx").agg(*(F.min(c).alias(c) for c, _ in _BEYOND))
    beyond = lambda c, k: F.coalesce(~(F.abs(c) <= LIMITS[k]), F.lit(True))
    bad = {k: beyond(c, k) for c, k in _BEYOND}
    out = f.groupBy("flight_id").agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"{k}_bad") for k, c in bad.items()), F.count_if(bad["flow_x"] | bad["flow_y"] | bad["dx"] | bad["dy"]).alias("bad"))
    return out


PHYSICAL_SQL = f"""WITH f AS (SELECT flight_id, frame_idx, {", ".join(f"min({c}) AS {c}" for c, _ in _BEYOND)} FROM lk_flow_physical_filtered GROUP BY 1, 2),
g AS (SELECT flight_id, {", ".join(f"coalesce(isnan({c}) OR abs({c}) > {LIMITS[k]!r}, TRUE) AS {k}" for c, k in _BEYOND)} FROM f)
SELECT flight_id, count(*) AS n, {", ".join(f"count(*) FILTER ({k}) AS {k}_bad" for _, k in _BEYOND)}, count(*) FILTER (flow_x OR flow_y OR dx OR dy) AS bad FROM g GROUP BY 1"""

TOPICS = ("/aid/velocity_body", "/aux/velocity_link")
PAD_NS = 1_000_000_000


def q_topic_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Log entries of chosen topics that arrived while a flight's camera ran, a second more on either side: how many, and the first and last arrival, per topic."""
    span = flow(spark, folder).filter("stamp_ns IS NOT NULL").groupBy("flight_id").agg(F.min("stamp_ns").alias("a"), F.max("stamp_ns").alias("b"))
    m = table(spark, folder, "decoded_record").filter(F.col("topic").isin(*TOPICS)).select("flight_id", "topic", "bag_timestamp_ns")
    d = join_checked(m, cut(span), KEY, "inner").filter(F.col("bag_timestamp_ns").between(F.col("a") - PAD_NS, F.col("b") + PAD_NS))
    return d.groupBy("flight_id", "topic").agg(F.count("*").alias("n"), F.min("bag_timestamp_ns").alias("first_ns"), F.max("bag_timestamp_ns").alias("last_ns"))


TOPIC_SQL = with_sql("flow", more="w AS (SELECT flight_id, min(stamp_ns) AS a, max(stamp_ns) AS b FROM flow WHERE stamp_ns IS NOT NULL GROUP BY 1)") + f"""SELECT flight_id, topic, count(*) AS n, min(bag_timestamp_ns) AS first_ns, max(bag_timestamp_ns) AS last_ns
FROM decoded_record JOIN w USING (flight_id) WHERE topic IN {TOPICS} AND bag_timestamp_ns BETWEEN a - {PAD_NS} AND b + {PAD_NS} GROUP BY 1, 2"""

FIT_SIGMA, HEIGHT_SIGMA = 5.0, 1.5
EXPORTED, INTERPOLATED = "fused_exported_u", "offline_interp"


def q_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """What a run's results say against it, per flight: a delay in doubt, offsets that fit worse than three sigmas, stale or outlying sparse fixes, heights worse than three sigmas of the barometer, no track; with the figure that tells."""
    def rule(d: DataFrame, severity: str, code: str, figure: Column) -> DataFrame:
        return d.select("flight_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.round(figure.cast("double"), 5).alias("figure"))

    quality = q_starlink_quality(spark, folder).groupBy("flight_id").agg(F.count_if(F.col("issue").contains("stale")).alias("stale"), F.count_if(F.col("issue").contains("outlier")).alias("far"))
    h = table(spark, folder, "fusion_height_aligned_samples").filter(finite(F.col("err_u")) & (F.col("series") == EXPORTED) & (F.col("matching_mode") == INTERPOLATED))
    h = h.select("flight_id", "tr", "err_u").distinct().groupBy("flight_id").agg(F.sqrt(F.avg(F.col("err_u") ** 2)).alias("rmse"))
    fixes = starlink(spark, folder).groupBy("flight_id").agg(F.count("*").alias("n"))
    parts = [
        rule(q_delay_scan(spark, folder).filter("doubt <> ''"), "warning", "delay_unreliable", F.col("tau")),
        rule(q_enu_offset(spark, folder).filter(F.col("after") > 3 * FIT_SIGMA), "warning", "offset_fit_against_sigma", F.col("after")),
        rule(quality.filter("stale > 0"), "warning", "stale_fixes", F.col("stale")),
        rule(quality.filter("far > 0"), "warning", "outlying_fixes", F.col("far")),
        rule(h.filter(F.col("rmse") > 3 * HEIGHT_SIGMA), "warning", "height_error_against_sigma", F.col("rmse")),
        rule(fixes.join(nodes(spark, folder).select("flight_id").distinct(), "flight_id", "left_anti"), "error", "no_track", F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


DIAGNOSTICS_SQL = f"""WITH q AS ({STARLINK_SQL}), h AS (SELECT flight_id, sqrt(avg(err_u ** 2)) AS rmse FROM (SELECT DISTINCT flight_id, tr, err_u FROM fusion_height_aligned_samples
  WHERE isfinite(err_u) AND series = '{EXPORTED}' AND matching_mode = '{INTERPOLATED}') GROUP BY 1), {NODES}, {with_sql("starlink")[5:].rstrip()},
r AS (SELECT flight_id, 'warning' AS severity, 'delay_unreliable' AS code, CAST(tau AS DOUBLE) AS figure FROM ({DELAY_SQL}) WHERE doubt <> ''
UNION ALL SELECT flight_id, 'warning', 'offset_fit_against_sigma', after FROM ({ENU_OFFSET_SQL}) WHERE after > {3 * FIT_SIGMA}
UNION ALL SELECT flight_id, 'warning', 'stale_fixes', count(*) FROM q WHERE contains(issue, 'stale') GROUP BY 1
UNION ALL SELECT flight_id, 'warning', 'outlying_fixes', count(*) FROM q WHERE contains(issue, 'outlier') GROUP BY 1
UNION ALL SELECT flight_id, 'warning', 'height_error_against_sigma', rmse FROM h WHERE rmse > {3 * HEIGHT_SIGMA}
UNION ALL SELECT flight_id, 'error', 'no_track', count(*) FROM starlink WHERE flight_id NOT IN (SELECT flight_id FROM nodes) GROUP BY 1)
SELECT flight_id, severity, code, round(figure, 5) AS figure FROM r"""

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and v.__module__ == __name__}
SQL = {
    "q_position_errors": POSITION_SQL,
    "q_smooth_export": EXPORT_SQL,
    "q_alignment_filtered": ALIGN_SQL,
    "q_replay_windows": REPLAY_SQL,
    "q_strides": STRIDES_SQL,
    "q_finality": FINALITY_SQL,
    "q_active_interval": INTERVAL_SQL,
    "q_gyro_velocity": GYRO_SQL,
    "q_hold_filtered": HOLD_FILTERED_SQL,
    "q_iir_by_time": BY_TIME_SQL,
    "q_field_errors": _errors_sql(),
    "q_zero_fields": ZERO_SQL,
    "q_physical_gate": PHYSICAL_SQL,
    "q_topic_scan": TOPIC_SQL,
    "q_diagnostics": DIAGNOSTICS_SQL,
}
