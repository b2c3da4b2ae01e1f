"""Queries that bring series onto each other's times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions.missing import finite
from tracklane.operators.align import asof, interpolate
from tracklane.operators.delays import at_delays, judged_delay, middle, residual_scores
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, owned, slope
from tracklane.operators.positions import with_positions
from tracklane.sources.sensors import baro, flow, gps, messages, one_per_key, starlink, vision, with_sql
from tracklane.sources.tables import table

KEY = ["flight_id"]


def r6(c: str):
    return F.round(c, 6).alias(c)


def q_timebase_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Barometer rows on the time that starts with the first sensor row of all."""
    b = baro(spark, folder)
    firsts = [d.agg(F.min("t").alias("t0")) for d in (gps(spark, folder), b, vision(spark, folder))]
    t0 = firsts[0].unionByName(firsts[1]).unionByName(firsts[2]).agg(F.min("t0").alias("t0"))  # one row
    return b.crossJoin(F.broadcast(t0)).select("sample_id", "flight_id", F.round(F.col("t") - F.col("t0"), 6).alias("t_rel"), r6("u"))


TIMEBASE_SQL = with_sql("gps", "baro", "vision") + (
    "SELECT sample_id, flight_id, round(t - (SELECT min(t) FROM (SELECT t FROM gps UNION ALL SELECT t FROM baro UNION ALL SELECT t FROM vision)), 6) AS t_rel, round(u, 6) AS u FROM baro"
)


def _dedup(last: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "vision_velocity_corrected_frd").select("flight_id", "tr", "sample_id", "frame_id")
        return one_per_key(rows.filter(finite(F.col("tr"))), ["flight_id", "tr"], "sample_id", last=last)

    return run


def _dedup_sql(order: str) -> str:
    return f"""SELECT flight_id, tr, sample_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, tr ORDER BY sample_id {order}) AS rn
  FROM vision_velocity_corrected_frd WHERE isfinite(tr)) WHERE rn = 1"""


def _fix_baro(spark: SparkSession, folder: str) -> DataFrame:
    fixes = starlink(spark, folder).select("flight_id", "fix_id", "tr", F.col("u").alias("fix_u"))
    return asof(fixes, baro(spark, folder).select("flight_id", "tr", "u"), KEY, "tr", ["u"])


def q_asof_causal(spark: SparkSession, folder: str) -> DataFrame:
    """The last barometer height at or before each sparse fix, and how old it is."""
    return _fix_baro(spark, folder).select("flight_id", "fix_id", r6("fix_u"), r6("u"), r6("age"))


ASOF_SQL = with_sql("starlink", "baro") + (
    "SELECT s.flight_id, s.fix_id, round(s.u, 6) AS fix_u, round(b.u, 6) AS u, round(s.tr - b.tr, 6) AS age "
    "FROM starlink s ASOF LEFT JOIN baro b ON s.flight_id = b.flight_id AND s.tr >= b.tr"
)


def q_asof_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """Vision velocity with the dense fix before it, if that is not older than half a second."""
    g = gps(spark, folder).select("flight_id", "tr", "e", "n")
    v = vision(spark, folder).select("flight_id", "sample_id", "tr")
    return asof(v, g, KEY, "tr", ["e", "n"], tolerance=0.5).select("flight_id", "sample_id", r6("e"), r6("n"), r6("age"))


ASOF_TOL_SQL = with_sql("vision", "gps") + (
    "SELECT v.flight_id, v.sample_id, round(CASE WHEN v.tr - g.tr <= 0.5 THEN g.e END, 6) AS e, round(CASE WHEN v.tr - g.tr <= 0.5 THEN g.n END, 6) AS n, "
    "round(CASE WHEN v.tr - g.tr <= 0.5 THEN v.tr - g.tr END, 6) AS age FROM vision v ASOF LEFT JOIN gps g ON v.flight_id = g.flight_id AND v.tr >= g.tr"
)

_NEIGHBOURS = """j AS (SELECT b.*, p.tr AS t0, p.u AS u0, q.tr AS t1, q.u AS u1 FROM baro b
  ASOF LEFT JOIN gps p ON b.flight_id = p.flight_id AND b.tr >= p.tr ASOF LEFT JOIN gps q ON b.flight_id = q.flight_id AND b.tr < q.tr)"""


def _interp(clamp: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        b = baro(spark, folder).select("flight_id", "sample_id", "tr", "u")
        out = interpolate(b, gps(spark, folder).select("flight_id", "tr", F.col("u").alias("g")), KEY, "tr", ["g"], clamp)
        return out.select("flight_id", "sample_id", F.round("g_at", 6).alias("u_gps"))

    return run


def _interp_sql(clamp: bool) -> str:
    end = "u0" if clamp else "CASE WHEN t0 = tr THEN u0 END"
    begin = "u1" if clamp else "NULL"
    return with_sql("gps", "baro", more=_NEIGHBOURS) + (
        f"SELECT flight_id, sample_id, round(CASE WHEN t0 IS NULL THEN {begin} WHEN t1 IS NULL THEN {end} "
        "ELSE u0 + (u1 - u0) * ((tr - t0) / (t1 - t0)) END, 6) AS u_gps FROM j"
    )


def trim_sql(source: str, k: str) -> str:
    """Tables up to tu: rows of ``source`` by flight and ``k`` with what a robust mean of vx, vy, vz keeps (near, or all where it does not trim)."""
    return f"""tm AS (SELECT flight_id, {k} AS k, count(*) AS n, quantile_cont(vx, 0.5) AS mx, quantile_cont(vy, 0.5) AS my, quantile_cont(vz, 0.5) AS mz FROM {source} GROUP BY 1, 2),
tr AS (SELECT v.flight_id, tm.k, n, vx, vy, vz, sqrt((vx - mx) ** 2 + (vy - my) ** 2 + (vz - mz) ** 2) AS r FROM {source} v JOIN tm ON tm.flight_id = v.flight_id AND tm.k = {k}),
ts AS (SELECT flight_id, k, quantile_cont(r, 0.5) AS rm, 1.4826 * mad(r) AS rs FROM tr GROUP BY 1, 2),
tt AS (SELECT tr.*, n >= 5 AND rs > 1e-6 AS trim_, r <= rm + 3.5 * rs AS near FROM tr JOIN ts USING (flight_id, k)),
tc AS (SELECT flight_id, k, n AS m, count(*) FILTER (near) AS near_n, bool_or(trim_) AS trims FROM tt GROUP BY 1, 2, 3),
tu AS (SELECT tt.*, tc.trims AND near_n >= greatest(2, n // 3) AS does FROM tt JOIN tc USING (flight_id, k))"""


def errors(spark: SparkSession, folder: str) -> DataFrame:
    """Barometer height against the dense reference before it."""
    g = gps(spark, folder).select("flight_id", "tr", F.col("u").alias("ref"))
    d = asof(baro(spark, folder).select("flight_id", "sample_id", "tr", "u"), g, KEY, "tr", ["ref"]).filter("ref IS NOT NULL")
    return d.withColumn("err", F.col("u") - F.col("ref")).withColumn("abs_err", F.abs(F.col("u") - F.col("ref")))


ERRORS = """er AS (SELECT b.flight_id, b.sample_id, b.tr, b.tr - g.tr AS age, b.u - g.u AS err, abs(b.u - g.u) AS abs_err
  FROM baro b ASOF JOIN gps g ON b.flight_id = g.flight_id AND b.tr >= g.tr)"""


def q_error_summary(spark: SparkSession, folder: str) -> DataFrame:
    """n, bias, RMSE, MAE, 95th percentile and maximum of the height error, and the age of the reference, per flight."""
    d = errors(spark, folder)
    sums = d.groupBy("flight_id").agg(
        F.count("*").alias("n"), F.avg("err").alias("bias"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg("abs_err").alias("mae"), F.max("abs_err").alias("max_abs"), F.max("age").alias("age_max"),
    )
    both = d.select("flight_id", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("x")) for c in ("abs_err", "age")))).alias("m")).select("flight_id", "m.*")
    tail = exact_percentiles(both, [*KEY, "of"], "x", {"p": 0.95}).groupBy("flight_id").agg(F.max(F.when(F.col("of") == "abs_err", F.col("p"))).alias("p95"), F.max(F.when(F.col("of") == "age", F.col("p"))).alias("age_p95"))
    return sums.join(tail, "flight_id").select("flight_id", "n", *map(r6, ("bias", "rmse", "mae", "p95", "max_abs", "age_p95", "age_max")))


ERROR_SUMMARY_SQL = with_sql("gps", "baro", more=ERRORS) + (
    "SELECT flight_id, count(*) AS n, round(avg(err), 6) AS bias, round(sqrt(avg(err * err)), 6) AS rmse, round(avg(abs_err), 6) AS mae, round(quantile_cont(abs_err, 0.95), 6) AS p95, "
    "round(max(abs_err), 6) AS max_abs, round(quantile_cont(age, 0.95), 6) AS age_p95, round(max(age), 6) AS age_max FROM er GROUP BY flight_id"
)


def q_error_by_bin(spark: SparkSession, folder: str) -> DataFrame:
    d = errors(spark, folder).withColumn("bin_id", F.floor(F.col("tr") / 60))
    out = d.groupBy("flight_id", "bin_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.max("abs_err").alias("max_abs"))
    return out.select("flight_id", "bin_id", (F.col("bin_id") * 60.0).alias("bin_start_sec"), "n", r6("rmse"), r6("max_abs"))


ERROR_BIN_SQL = with_sql("gps", "baro", more=ERRORS) + (
    "SELECT flight_id, CAST(floor(tr / 60) AS BIGINT) AS bin_id, floor(tr / 60) * 60.0 AS bin_start_sec, count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse, "
    "round(max(abs_err), 6) AS max_abs FROM er GROUP BY ALL"
)


def q_common_support(spark: SparkSession, folder: str) -> DataFrame:
    """The time that all three series of a flight cover: the latest start to the earliest end."""
    spans = [d.groupBy("flight_id").agg(F.min("tr").alias("a"), F.max("tr").alias("b")) for d in (gps(spark, folder), baro(spark, folder), vision(spark, folder))]
    both = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy("flight_id").agg(F.count("*").alias("n"), F.max("a").alias("start"), F.min("b").alias("end"))
    return both.filter("n = 3").select("flight_id", r6("start"), r6("end"), (F.col("start") < F.col("end")).alias("overlap"))


SUPPORT_SQL = with_sql("gps", "baro", "vision", more="s AS (SELECT flight_id, min(tr) AS a, max(tr) AS b FROM gps GROUP BY 1 UNION ALL SELECT flight_id, min(tr), max(tr) FROM baro GROUP BY 1 UNION ALL SELECT flight_id, min(tr), max(tr) FROM vision GROUP BY 1)") + (
    'SELECT flight_id, round(max(a), 6) AS start, round(min(b), 6) AS "end", max(a) < min(b) AS overlap FROM s GROUP BY flight_id HAVING count(*) = 3'
)


SPARSE_FEW = 8
SPARSE_REACH, STEP = 3.0, 0.02  # seconds of delay tried either way, and by what steps


def delay_grid(reach: float) -> list[float]:
    return [i / 50 for i in range(-round(reach * 50), round(reach * 50) + 1)]


def slope_sql(y: str) -> str:
    return (
        f"CASE WHEN lag({y}) OVER w IS NULL THEN (lead({y}) OVER w - {y}) / (lead(tr) OVER w - tr) WHEN lead({y}) OVER w IS NULL THEN ({y} - lag({y}) OVER w) / (tr - lag(tr) OVER w) "
        f"ELSE ((tr - lag(tr) OVER w) ** 2 * lead({y}) OVER w + ((lead(tr) OVER w - tr) ** 2 - (tr - lag(tr) OVER w) ** 2) * {y} - (lead(tr) OVER w - tr) ** 2 * lag({y}) OVER w) "
        f"/ ((tr - lag(tr) OVER w) * (lead(tr) OVER w - tr) * (lead(tr) OVER w - lag(tr) OVER w)) END"
    )


def q_delay_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Delay of the sparse fixes against the dense ones: of a grid by 0.02 s the one of the least median distance, while the dense fixes move faster than 1 m/s and without the median distance east and north of the delay; with the RMSE and what makes the delay doubtful."""
    g = in_blocks(gps(spark, folder).select("flight_id", "tr", "e", "n"), KEY, ["tr"], F.floor(F.col("tr") / 600), 1, 1)
    w = block_window(KEY)
    g = owned(g.withColumn("speed", F.hypot(slope("e", "tr", w), slope("n", "tr", w)))).select("flight_id", "tr", "e", "n", "speed")
    s = starlink(spark, folder).select("flight_id", "tr", F.col("e").alias("se"), F.col("n").alias("sn"))
    d = at_delays(s, g, KEY, "tr", ["e", "n", "speed"], delay_grid(SPARSE_REACH)).filter("speed_at > 1")
    d = d.select("flight_id", "delay", (F.col("se") - F.col("e_at")).alias("de"), (F.col("sn") - F.col("n_at")).alias("dn"))
    far = F.hypot(F.col("de") - F.col("oe"), F.col("dn") - F.col("on"))
    scores = {"score": middle("res"), "rmse": F.sqrt(F.avg(F.col("res") ** 2))}
    scored = residual_scores(d, KEY, lambda: [middle("de").alias("oe"), middle("dn").alias("on")], far, scores)
    return judged_delay(scored, KEY, "rmse", SPARSE_REACH, 1.0, SPARSE_FEW)


def judged_sql(more: str, edge: float, flat: float, few: int) -> str:
    """The same of a table sc(flight_id, delay, n, score, ``more``)."""
    return f"""SELECT flight_id, score, tau, n, {more}, span, concat_ws('+', CASE WHEN abs(tau) > {edge} - 0.03 THEN 'edge' END, CASE WHEN n < {few} THEN 'few' END, CASE WHEN span_ < {flat} THEN 'flat' END) AS doubt
FROM (SELECT flight_id, round(score, 6) AS score, delay AS tau, n, round({more}, 6) AS {more}, row_number() OVER (PARTITION BY flight_id ORDER BY round(score, 6), delay) AS rn,
  quantile_cont(score, 0.9) OVER f - min(score) OVER f AS span_, round(quantile_cont(score, 0.9) OVER f - min(score) OVER f, 5) AS span FROM sc WINDOW f AS (PARTITION BY flight_id)) WHERE rn = 1"""


def _delay_sql() -> str:
    line = lambda c: f"CASE WHEN t1 IS NULL THEN CASE WHEN t0 = tr THEN {c}0 END ELSE {c}0 + ({c}1 - {c}0) * ((tr - t0) / (t1 - t0)) END"
    return with_sql("gps", "starlink", more=f"""
g0 AS (SELECT flight_id, tr, e, n, {slope_sql('e')} AS ve, {slope_sql('n')} AS vn FROM gps WINDOW w AS (PARTITION BY flight_id ORDER BY tr)),
gs AS (SELECT flight_id, tr, e, n, sqrt(ve ** 2 + vn ** 2) AS s FROM g0),
g AS (SELECT s.flight_id, s.fix_id, i / 50.0 AS delay, s.tr - i / 50.0 AS tr, s.e AS se, s.n AS sn FROM starlink s, range(-150, 151) r(i)),
j AS (SELECT g.*, p.tr AS t0, p.e AS e0, p.n AS n0, p.s AS s0, q.tr AS t1, q.e AS e1, q.n AS n1, q.s AS s1 FROM g
  ASOF JOIN gs p ON g.flight_id = p.flight_id AND g.tr >= p.tr ASOF LEFT JOIN gs q ON g.flight_id = q.flight_id AND g.tr < q.tr),
d AS (SELECT flight_id, delay, se - ({line('e')}) AS de, sn - ({line('n')}) AS dn, {line('s')} AS s FROM j),
dd AS (SELECT * FROM d WHERE s > 1), o AS (SELECT flight_id, delay, quantile_disc(de, 0.5) AS oe, quantile_disc(dn, 0.5) AS o_n FROM dd GROUP BY 1, 2),
r AS (SELECT flight_id, delay, sqrt((de - oe) ** 2 + (dn - o_n) ** 2) AS res FROM dd JOIN o USING (flight_id, delay)),
sc AS (SELECT flight_id, CAST(delay AS DOUBLE) AS delay, count(*) AS n, quantile_disc(res, 0.5) AS score, sqrt(avg(res ** 2)) AS rmse FROM r GROUP BY 1, 2 HAVING count(*) >= 5)""") + judged_sql("rmse", SPARSE_REACH, 1.0, SPARSE_FEW)


DELAY_SQL = _delay_sql()


def q_merge_order(spark: SparkSession, folder: str) -> DataFrame:
    """One log of messages and flow frames per flight: at one time the messages first, then frames; counted by source and minute."""
    m = messages(spark, folder).select("flight_id", F.col("bag_timestamp_ns").alias("ns"), F.lit(0).alias("class"), F.col("msg_seq").alias("seq"))
    f = flow(spark, folder).filter("stamp_ns IS NOT NULL").select("flight_id", F.col("stamp_ns").alias("ns"), F.lit(2).alias("class"), F.col("frame_idx").alias("seq"))
    log = with_positions(m.unionByName(f), KEY, ["ns", "class", "seq"], F.floor(F.col("ns") / 600_000_000_000))
    return log.select("flight_id", "class", "seq", F.col("pos").alias("place"))


MERGE_SQL = with_sql("messages", "flow", more="l AS (SELECT flight_id, bag_timestamp_ns AS ns, 0 AS class, msg_seq AS seq FROM messages UNION ALL SELECT flight_id, stamp_ns, 2, frame_idx FROM flow WHERE stamp_ns IS NOT NULL)") + (
    "SELECT flight_id, class, seq, row_number() OVER (PARTITION BY flight_id ORDER BY ns, class, seq) - 1 AS place FROM l"
)


def q_zip_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The i-th vision row beside the i-th dense fix of a flight, whatever their times; what either lacks stays empty."""
    v = with_positions(vision(spark, folder).select("flight_id", "tr", "vx"), KEY, ["tr"], F.floor(F.col("tr") / 600))
    g = with_positions(gps(spark, folder).select("flight_id", F.col("tr").alias("tr_g"), "u"), KEY, ["tr_g"], F.floor(F.col("tr_g") / 600))
    z = v.join(g, ["flight_id", "pos"], "full")
    d = F.col("tr") - F.col("tr_g")
    return z.groupBy("flight_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("tr").isNull()).alias("only_right"), F.count_if(F.col("tr_g").isNull()).alias("only_left"),
        F.round(F.min(d), 6).alias("least"), F.round(F.max(d), 6).alias("most"), F.round(F.avg(F.abs(d)), 6).alias("mean_abs"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rms"),
    )


ZIP_SQL = with_sql("vision", "gps", more="v AS (SELECT flight_id, tr, row_number() OVER (PARTITION BY flight_id ORDER BY tr) AS i FROM vision), g AS (SELECT flight_id, tr AS tr_g, row_number() OVER (PARTITION BY flight_id ORDER BY tr) AS i FROM gps)") + (
    "SELECT flight_id, count(*) AS n, count(*) FILTER (tr IS NULL) AS only_right, count(*) FILTER (tr_g IS NULL) AS only_left, round(min(tr - tr_g), 6) AS least, "
    "round(max(tr - tr_g), 6) AS most, round(avg(abs(tr - tr_g)), 6) AS mean_abs, round(sqrt(avg((tr - tr_g) ** 2)), 6) AS rms FROM v FULL JOIN g USING (flight_id, i) GROUP BY flight_id"
)


def q_equi_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """Flow frames and their golden copy joined one to one, keys that are not unique on either side told apart."""
    a = flow(spark, folder).select("flight_id", "frame_idx", F.col("t_sec").alias("a"))
    b = table(spark, folder, "lk_flow_golden").select("flight_id", "frame_idx", F.when(finite(F.col("t_sec")), F.col("t_sec")).alias("b")).distinct()
    ua = a.groupBy("flight_id", "frame_idx").agg(F.count("*").alias("na"), F.min("a").alias("a"))
    ub = b.groupBy("flight_id", "frame_idx").agg(F.count("*").alias("nb"), F.min("b").alias("b"))
    j = ua.join(ub, ["flight_id", "frame_idx"])
    return j.groupBy("flight_id").agg(F.count("*").alias("n"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("not_unique"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("most"))


EQUI_SQL = with_sql("flow", more="ua AS (SELECT flight_id, frame_idx, count(*) AS na, min(a) AS a FROM (SELECT flight_id, frame_idx, t_sec AS a FROM flow) GROUP BY 1, 2), ub AS (SELECT flight_id, frame_idx, count(*) AS nb, min(b) AS b FROM (SELECT DISTINCT flight_id, frame_idx, CASE WHEN isfinite(t_sec) THEN t_sec END AS b FROM lk_flow_golden) GROUP BY 1, 2)") + (
    "SELECT flight_id, count(*) AS n, count(*) FILTER (na > 1 OR nb > 1) AS not_unique, round(max(abs(a - b)), 6) AS most FROM ua JOIN ub USING (flight_id, frame_idx) GROUP BY flight_id"
)


def q_range_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Height errors in closed windows of time, two of them open at one end: a join on ranges with a table of five rows."""
    windows = spark.createDataFrame([("all", None, None), ("first", None, 60.0), ("60_180", 60.0, 180.0), ("180_360", 180.0, 360.0), ("rest", 360.0, None)], "scope string, a double, b double")
    inside = (F.col("a").isNull() | (F.col("tr") >= F.col("a"))) & (F.col("b").isNull() | (F.col("tr") <= F.col("b")))
    return errors(spark, folder).join(F.broadcast(windows), inside).groupBy("scope").agg(F.count("*").alias("n"), F.round(F.avg("err"), 6).alias("bias"), F.round(F.sqrt(F.avg(F.col("err") ** 2)), 6).alias("rmse"))


RANGE_SQL = with_sql("gps", "baro", more=ERRORS + ", w AS (SELECT * FROM (VALUES ('all', NULL, NULL), ('first', NULL, 60.0), ('60_180', 60.0, 180.0), ('180_360', 180.0, 360.0), ('rest', 360.0, NULL)) v(scope, a, b))") + (
    "SELECT scope, count(*) AS n, round(avg(err), 6) AS bias, round(sqrt(avg(err ** 2)), 6) AS rmse FROM er JOIN w ON (a IS NULL OR tr >= a) AND (b IS NULL OR tr <= b) GROUP BY scope"
)

QUERIES = {
    "q_timebase_norm": q_timebase_norm,
    "q_dedup_first": _dedup(False),
    "q_dedup_last": _dedup(True),
    "q_asof_causal": q_asof_causal,
    "q_asof_tolerance": q_asof_tolerance,
    "q_interp_nan": _interp(False),
    "q_interp_clamped": _interp(True),
    "q_error_summary": q_error_summary,
    "q_error_by_bin": q_error_by_bin,
    "q_common_support": q_common_support,
    "q_delay_scan": q_delay_scan,
    "q_merge_order": q_merge_order,
    "q_zip_compare": q_zip_compare,
    "q_equi_one_to_one": q_equi_one_to_one,
    "q_range_windows": q_range_windows,
}
SQL = {
    "q_timebase_norm": TIMEBASE_SQL,
    "q_dedup_first": _dedup_sql(""),
    "q_dedup_last": _dedup_sql("DESC"),
    "q_asof_causal": ASOF_SQL,
    "q_asof_tolerance": ASOF_TOL_SQL,
    "q_interp_nan": _interp_sql(False),
    "q_interp_clamped": _interp_sql(True),
    "q_error_summary": ERROR_SUMMARY_SQL,
    "q_error_by_bin": ERROR_BIN_SQL,
    "q_common_support": SUPPORT_SQL,
    "q_delay_scan": DELAY_SQL,
    "q_merge_order": MERGE_SQL,
    "q_zip_compare": ZIP_SQL,
    "q_equi_one_to_one": EQUI_SQL,
    "q_range_windows": RANGE_SQL,
}
