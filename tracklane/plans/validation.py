"""Queries that compare variants: on the same support, over blocked windows, with held-out selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklane.functions.missing import finite
from tracklane.operators.align import asof, neighbours
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, owned
from tracklane.operators.joins import join_checked
from tracklane.operators.robust import robust_sigma, robust_vector_mean
from tracklane.plans.alignment import KEY, r6, trim_sql
from tracklane.session import cut
from tracklane.sources.sensors import baro, flow, gps, starlink, vision, with_sql
from tracklane.sources.tables import table

# The windows of the blocked validation: name, offset, duration, role; both ends are in.
BLOCKS = [(f"long_o{o:03d}_d180", float(o), 180.0, "primary") for o in (0, 180, 360, 540, 720, 900)] + [(f"short_o{o:03d}_d040", float(o), 40.0, "startup_stress") for o in (30, 300, 600, 900)]
BASE, CANDIDATE = "prepared_baro_u", "fused_raw_u"


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """All aligned height samples with a time and an error, exact repeats dropped."""
    d = table(spark, folder, "fusion_height_aligned_samples").filter(finite(F.col("err_u")) & finite(F.col("tr")))
    return d.select("flight_id", "tr", "series", "matching_mode", "err_u").distinct()


SAMPLES = "a AS (SELECT DISTINCT flight_id, tr, series, matching_mode, err_u FROM fusion_height_aligned_samples WHERE isfinite(err_u) AND isfinite(tr))"


def q_variant_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Every series and mode on the time that all series of a flight cover in that mode."""
    d = _samples(spark, folder)
    spans = d.groupBy("flight_id", "matching_mode", "series").agg(F.min("tr").alias("a"), F.max("tr").alias("b"))
    support = cut(spans.groupBy("flight_id", "matching_mode").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("k")).filter("k = 3").drop("k"))
    d = join_checked(d, support, ["flight_id", "matching_mode"], "inner").filter(F.col("tr").between(F.col("a"), F.col("b")))
    keys = ["series", "matching_mode"]
    sums = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("err_u").alias("bias"), F.sqrt(F.avg(F.col("err_u") ** 2)).alias("rmse"))
    tail = exact_percentiles(d.withColumn("size", F.abs("err_u")), keys, "size", {"p95": 0.95, "most": 1.0}).drop("n")
    return sums.join(tail, keys).select(*keys, "n", *map(r6, ("bias", "rmse", "p95", "most")))


VARIANT_SQL = f"""WITH {SAMPLES}, s AS (SELECT flight_id, matching_mode, series, min(tr) AS a, max(tr) AS b FROM a GROUP BY ALL),
u AS (SELECT flight_id, matching_mode, max(a) AS a, min(b) AS b FROM s GROUP BY ALL HAVING count(*) = 3)
SELECT series, matching_mode, count(*) AS n, round(avg(err_u), 6) AS bias, round(sqrt(avg(err_u ** 2)), 6) AS rmse, round(quantile_cont(abs(err_u), 0.95), 6) AS p95, round(max(abs(err_u)), 6) AS most
FROM a JOIN u USING (flight_id, matching_mode) WHERE tr BETWEEN u.a AND u.b GROUP BY ALL"""


def _block_scores(spark: SparkSession, folder: str, role: str | None = "primary") -> DataFrame:
    """Mean square error of every series and mode in the windows of a role (None: of all); policy is both, in order of preference."""
    blocks = spark.createDataFrame([b for b in BLOCKS if role in (None, b[3])], "win string, a double, duration double, role string")
    inside = F.col("tr").between(F.col("a"), F.col("a") + F.col("duration"))
    d = _samples(spark, folder).join(F.broadcast(blocks), inside)  # ten rows
    d = d.groupBy("win", "role", "series", "matching_mode").agg(F.avg(F.col("err_u") ** 2).alias("mse"), F.count("*").alias("n"))
    return d.withColumn("policy", F.concat_ws("/", "series", "matching_mode"))


SCORES = f"""{SAMPLES}, bl AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {o}, {d}, '{r}')" for n, o, d, r in BLOCKS)}) v(win, lo, duration, role)),
sc AS (SELECT win, role, series, matching_mode, series || '/' || matching_mode AS policy, avg(err_u ** 2) AS mse, count(*) AS n FROM a JOIN bl ON tr BETWEEN lo AND lo + duration GROUP BY ALL)"""


def q_variant_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every series and mode in every window of the blocked validation: samples and RMSE, and the rank of the RMSE in its window."""
    d = cut(_block_scores(spark, folder, None))  # windows times policies: 60 rows
    place = F.rank().over(Window.partitionBy("win").orderBy(F.round("mse", 9)))
    return d.select("win", "role", "series", "matching_mode", "n", F.round(F.sqrt("mse"), 6).alias("rmse"), place.cast("bigint").alias("place"))


WINDOWS_SQL = f"WITH {SCORES} SELECT win, role, series, matching_mode, n, round(sqrt(mse), 6) AS rmse, rank() OVER (PARTITION BY win ORDER BY round(mse, 9)) AS place FROM sc"


def q_window_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the candidate beats the base: wins, median and worst improvement and pooled RMSE over the windows, and the verdict of fixed gates over the primary windows of 180 s, provided that both have as many samples in every window of either kind; the stress windows of 40 s are judged beside them, without verdict."""
    s = cut(_block_scores(spark, folder, None))  # windows times policies: 60 rows
    pick = lambda name, c: F.max(F.when(F.col("series") == name, F.col(c)))
    w = s.groupBy("matching_mode", "role", "win").agg(F.sqrt(pick(BASE, "mse")).alias("b"), F.sqrt(pick(CANDIDATE, "mse")).alias("c"), F.coalesce(pick(BASE, "n"), F.lit(0)).alias("nb"), F.coalesce(pick(CANDIDATE, "n"), F.lit(0)).alias("nc"))
    both = F.col("b").isNotNull() & F.col("c").isNotNull() & (F.col("b") > 0)
    gain = F.when(both, 100 * (F.col("b") - F.col("c")) / F.col("b"))
    pooled = lambda x, n: F.sqrt(F.sum(F.col(x) ** 2 * F.col(n)) / F.sum(F.when(F.col(x).isNotNull(), F.col(n))))
    d = w.groupBy("matching_mode", "role").agg(
        F.count(gain).alias("windows"), F.count_if(both & (F.col("c") < F.col("b"))).alias("wins"), F.percentile(gain, 0.5).alias("mid"), F.min(gain).alias("worst"),
        F.count_if(F.col("nb") != F.col("nc")).alias("unequal_windows"), pooled("b", "nb").alias("base_rmse"), pooled("c", "nc").alias("candidate_rmse"),
    )
    verdict = (F.col("wins") >= 5) & (F.col("mid") >= 5) & (F.col("worst") >= -10) & (F.col("unequal_windows") == 0)
    d = d.withColumn("unequal_windows", F.sum("unequal_windows").over(Window.partitionBy("matching_mode")))  # two rows a mode
    out = d.filter("windows > 0").withColumn("accepted", F.when(F.col("role") == "primary", verdict))
    return out.select("matching_mode", "role", "windows", "wins", *map(r6, ("mid", "worst", "base_rmse", "candidate_rmse")), "unequal_windows", "accepted")


DECISION_SQL = f"""WITH {SCORES}, w AS (SELECT matching_mode, role, win, max(sqrt(mse)) FILTER (series = '{BASE}') AS b, max(sqrt(mse)) FILTER (series = '{CANDIDATE}') AS c,
  coalesce(max(n) FILTER (series = '{BASE}'), 0) AS nb, coalesce(max(n) FILTER (series = '{CANDIDATE}'), 0) AS nc FROM sc GROUP BY ALL),
g AS (SELECT *, CASE WHEN b IS NOT NULL AND c IS NOT NULL AND b > 0 THEN 100 * (b - c) / b END AS gain FROM w),
d AS (SELECT matching_mode, role, count(gain) AS windows, count(*) FILTER (gain IS NOT NULL AND c < b) AS wins, quantile_cont(gain, 0.5) AS m, min(gain) AS l, count(*) FILTER (nb <> nc) AS uneq,
  sqrt(sum(b ** 2 * nb) / sum(nb) FILTER (b IS NOT NULL)) AS rb, sqrt(sum(c ** 2 * nc) / sum(nc) FILTER (c IS NOT NULL)) AS rc FROM g GROUP BY ALL)
SELECT matching_mode, role, windows, wins, round(m, 6) AS mid, round(l, 6) AS worst, round(rb, 6) AS base_rmse, round(rc, 6) AS candidate_rmse, unequal_windows,
CASE WHEN role = 'primary' THEN wins >= 5 AND m >= 5 AND l >= -10 AND unequal_windows = 0 END AS accepted
FROM (SELECT *, CAST(sum(uneq) OVER (PARTITION BY matching_mode) AS BIGINT) AS unequal_windows FROM d) WHERE windows > 0"""


def q_lobo_select(spark: SparkSession, folder: str) -> DataFrame:
    """Leave one primary window out: the policy best on the other windows (first by name of equals), and its error on the one left out."""
    s = cut(_block_scores(spark, folder).select("win", "policy", "mse"))  # windows times policies: 36 rows
    held = s.select(F.col("win").alias("held")).distinct()
    train = held.join(s, F.col("held") != F.col("win")).groupBy("held", "policy").agg(F.avg("mse").alias("score"))
    best = train.groupBy("held").agg(F.min(F.struct(F.round("score", 9).alias("score"), "policy")).alias("b")).select("held", "b.policy")
    out = best.join(s.withColumnRenamed("win", "held"), ["held", "policy"])
    return out.select("held", "policy", F.round(F.sqrt("mse"), 6).alias("rmse"))


LOBO_SQL = f"""WITH {SCORES}, s AS (SELECT win, policy, mse FROM sc WHERE role = 'primary'), h AS (SELECT DISTINCT win AS held FROM s), t AS (SELECT held, policy, round(avg(mse), 9) AS score FROM h JOIN s ON held <> win GROUP BY ALL),
b AS (SELECT held, policy FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY score, policy) AS rn FROM t) WHERE rn = 1)
SELECT held, b.policy, round(sqrt(mse), 6) AS rmse FROM b JOIN s ON s.win = held AND s.policy = b.policy"""


def q_sign_permutation(spark: SparkSession, folder: str) -> DataFrame:
    """Exact paired sign-flip test of candidate against base over the primary windows, of which there are six, so 64 signs: the share of all signs with a mean as large."""
    side = lambda name: F.max(F.when(F.col("series") == name, F.col("mse")))
    w = _block_scores(spark, folder).groupBy("matching_mode", "win").agg((side(BASE) - side(CANDIDATE)).alias("d")).filter("d IS NOT NULL")
    g = w.groupBy("matching_mode").agg(F.sort_array(F.collect_list(F.struct("win", "d"))).alias("ds"))
    g = g.select("matching_mode", F.col("ds.d").alias("d")).withColumn("n", F.size("d"))
    g = g.withColumn("mask", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.col("n")) - 1).cast("int"))))
    mean = F.expr("aggregate(sequence(0, n - 1), 0.0D, (acc, i) -> acc + d[i] * (CASE WHEN (mask div cast(power(2, i) AS int)) % 2 = 1 THEN 1.0D ELSE -1.0D END)) / n")
    g = g.withColumn("mean", mean).withColumn("seen", F.expr("aggregate(d, 0.0D, (acc, x) -> acc + x) / n"))
    return g.groupBy("matching_mode").agg(F.max("n").cast("bigint").alias("windows"), F.round(F.max("seen"), 6).alias("mean_gain"), F.round(F.avg((F.col("mean") >= F.col("seen") - 1e-9).cast("double")), 6).alias("p_value"))


PERMUTATION_SQL = f"""WITH {SCORES}, w AS (SELECT matching_mode, win, max(mse) FILTER (series = '{BASE}') - max(mse) FILTER (series = '{CANDIDATE}') AS d FROM sc WHERE role = 'primary' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY matching_mode ORDER BY win) - 1 AS i, count(*) OVER (PARTITION BY matching_mode) AS k, avg(d) OVER (PARTITION BY matching_mode) AS seen FROM w WHERE d IS NOT NULL),
m AS (SELECT matching_mode, k, seen, mask, avg(CASE WHEN (mask >> i) & 1 = 1 THEN d ELSE -d END) AS mean FROM n, range(0, 64) r(mask) WHERE mask < (1 << k) GROUP BY ALL)
SELECT matching_mode, k AS windows, round(seen, 6) AS mean_gain, round(avg(CASE WHEN mean >= seen - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM m GROUP BY ALL"""


def q_motion_start(spark: SparkSession, folder: str) -> DataFrame:
    """When a flight moves: the first time above 8 m/s from which, until the hold of 5 s has passed, 60 percent of at least two samples are above; the end of that hold."""
    v = vision(spark, folder).select("flight_id", "tr", F.hypot("vx", "vy").alias("s"))
    starts = v.filter("s > 8").select("flight_id", F.col("tr").alias("t0"))
    # the hold ends at the first sample 5 s on; samples in between lie in the same or the next 600 s
    first = neighbours(starts.select("flight_id", (F.col("t0") + 5).alias("tr"), "t0"), v, KEY, "tr", ["s"])
    at = F.when(F.col("prev.tr") == F.col("tr"), F.col("prev.tr")).otherwise(F.col("next.tr"))
    spans = first.select("flight_id", "t0", at.alias("t1")).filter("t1 IS NOT NULL")
    cell = lambda t: F.floor(t / 600)
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("t0")), cell(F.col("t1")))))
    inside = spans.join(v.withColumn("cell", cell(F.col("tr"))), ["flight_id", "cell"]).filter(F.col("tr").between(F.col("t0"), F.col("t1")))
    good = inside.groupBy("flight_id", "t0", "t1").agg(F.count("*").alias("n"), F.avg((F.col("s") > 8).cast("double")).alias("share")).filter("n >= 2 AND share >= 0.6")
    return good.groupBy("flight_id").agg(F.min_by("t1", "t0").alias("start")).select("flight_id", r6("start"))


MOTION_SQL = with_sql("vision", more="""v AS (SELECT flight_id, tr, sqrt(vx ** 2 + vy ** 2) AS s FROM vision), b AS (SELECT flight_id, tr AS t0, tr + 5 AS lim FROM v WHERE s > 8),
e AS (SELECT b.flight_id, t0, min(v.tr) AS t1 FROM b JOIN v ON v.flight_id = b.flight_id AND v.tr >= lim GROUP BY 1, 2),
g AS (SELECT e.flight_id, t0, t1 FROM e JOIN v ON v.flight_id = e.flight_id AND v.tr BETWEEN t0 AND t1 GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND avg(CASE WHEN s > 8 THEN 1.0 ELSE 0.0 END) >= 0.6)""") + (
    "SELECT flight_id, round(arg_min(t1, t0), 6) AS start FROM g GROUP BY 1"
)


def q_start_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Velocity along x at a flight's 30th second, from the first source that has one of at least 1 m/s: robust mean of ten or more vision rows of the 3 s before, a line through the fixes of the 30 s before, two fixes; else none."""
    t0 = 30.0
    v = robust_vector_mean(vision(spark, folder).filter(F.col("tr").between(t0 - 3, t0)), KEY, ["vx", "vy", "vz"]).filter("n >= 10").select("flight_id", F.hypot("vx", "vy").alias("s"))
    g = gps(spark, folder).filter(F.col("tr").between(0.0, t0))
    line = g.groupBy("flight_id").agg(F.count("*").alias("n"), (F.max("tr") - F.min("tr")).alias("span"), F.hypot(F.regr_slope("e", "tr"), F.regr_slope("n", "tr")).alias("s"))
    line = line.filter("n >= 5 AND span >= 0.001")
    last = g.groupBy("flight_id").agg(F.max(F.struct("tr", "e", "n")).alias("b"))
    far = join_checked(g, cut(last), KEY, "inner").withColumn("dt", F.col("b.tr") - F.col("tr")).filter(F.col("dt").between(0.5, 10.0))
    two = far.groupBy("flight_id").agg(F.max(F.struct("tr", F.hypot(F.col("b.e") - F.col("e"), F.col("b.n") - F.col("n")).alias("d"), "dt")).alias("r")).select("flight_id", (F.col("r.d") / F.col("r.dt")).alias("s"))
    found = None
    for rank, (name, d) in enumerate((("vision", v), ("line", line), ("two_points", two))):
        part = d.select("flight_id", F.lit(rank).alias("rank"), F.lit(name).alias("source"), "s")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("flight_id").agg(F.min(F.struct((F.col("s") < 1.0).alias("slow"), "rank", "source", "s")).alias("b"))
    return best.select("flight_id", "b.source", F.round("b.s", 5).alias("speed"), (~F.col("b.slow")).alias("moving"))


START_SQL = with_sql("vision", "gps", more="vw AS (SELECT * FROM vision WHERE tr BETWEEN 27 AND 30), " + trim_sql("vw", "0") + """, g AS (SELECT * FROM gps WHERE tr BETWEEN 0 AND 30),
l AS (SELECT flight_id, max(tr) AS bt, arg_max(e, tr) AS be, arg_max(n, tr) AS bn FROM g GROUP BY 1),
f AS (SELECT flight_id, 0 AS rank, 'vision' AS source, sqrt(avg(vx) FILTER (NOT does OR near) ** 2 + avg(vy) FILTER (NOT does OR near) ** 2) AS s FROM tu WHERE n >= 10 GROUP BY 1
 UNION ALL SELECT flight_id, 1, 'line', sqrt(regr_slope(e, tr) ** 2 + regr_slope(n, tr) ** 2) FROM g GROUP BY 1 HAVING count(*) >= 5 AND max(tr) - min(tr) >= 0.001
 UNION ALL SELECT flight_id, 2, 'two_points', arg_max(sqrt((be - e) ** 2 + (bn - n) ** 2) / (bt - tr), tr) FROM g JOIN l USING (flight_id) WHERE bt - tr BETWEEN 0.5 AND 10 GROUP BY 1)""") + (
    "SELECT flight_id, source, round(s, 5) AS speed, s >= 1.0 AS moving FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY s < 1.0, rank) AS rn FROM f) WHERE rn = 1"
)


def q_alignment_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Heights moved to meet the reference at 10 s: by the raw height there, or by the trailing median of 11 there; offset and RMSE of either from then on."""
    g = gps(spark, folder).select("flight_id", "tr", F.col("u").alias("ref"))
    d = in_blocks(asof(baro(spark, folder).select("flight_id", "tr", "u"), g, KEY, "tr", ["ref"]).drop("age"), KEY, ["tr"], F.floor(F.col("tr") / 600), 10, 0)
    d = owned(d.withColumn("med", F.percentile("u", 0.5).over(block_window(KEY).rowsBetween(-10, 0)))).filter("tr >= 10 AND ref IS NOT NULL")
    anchor = cut(d.groupBy("flight_id").agg(F.min_by(F.struct((F.col("ref") - F.col("u")).alias("raw"), (F.col("ref") - F.col("med")).alias("filtered")), "tr").alias("o")).select("flight_id", "o.*"))
    d = join_checked(d, anchor, KEY)
    rms = lambda x: F.round(F.sqrt(F.avg((x - F.col("ref")) ** 2)), 6)
    return d.groupBy("flight_id").agg(
        F.count("*").alias("n"), F.round(F.max("raw"), 6).alias("raw_offset"), F.round(F.max("filtered"), 6).alias("filtered_offset"),
        rms(F.col("u") + F.col("raw")).alias("raw_rmse"), rms(F.col("med") + F.col("filtered")).alias("filtered_rmse"),
    )


VARIANTS_SQL = with_sql("gps", "baro", more="""j AS (SELECT b.flight_id, b.tr, b.u, g.u AS ref FROM baro b ASOF LEFT JOIN gps g ON b.flight_id = g.flight_id AND b.tr >= g.tr),
m AS (SELECT *, quantile_cont(u, 0.5) OVER (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS med FROM j), d AS (SELECT * FROM m WHERE tr >= 10 AND ref IS NOT NULL),
o AS (SELECT flight_id, arg_min(ref - u, tr) AS ro, arg_min(ref - med, tr) AS fo FROM d GROUP BY 1)""") + (
    "SELECT flight_id, count(*) AS n, round(max(ro), 6) AS raw_offset, round(max(fo), 6) AS filtered_offset, round(sqrt(avg((u + ro - ref) ** 2)), 6) AS raw_rmse, round(sqrt(avg((med + fo - ref) ** 2)), 6) AS filtered_rmse FROM d JOIN o USING (flight_id) GROUP BY 1"
)


def q_sensor_explain(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of barometer and sparse fixes against the dense reference before them, per minute: what a bad window was due to."""
    g = gps(spark, folder).select("flight_id", "tr", F.col("u").alias("ref"))
    out = None
    for name, d in (("baro", baro(spark, folder)), ("starlink", starlink(spark, folder))):
        e = asof(d.select("flight_id", "tr", "u"), g, KEY, "tr", ["ref"]).filter("ref IS NOT NULL").withColumn("err", F.col("u") - F.col("ref"))
        part = e.groupBy(F.floor(F.col("tr") / 60).alias("win")).agg(F.count("*").alias("n"), F.round(F.avg("err"), 6).alias("bias"), F.round(F.sqrt(F.avg(F.col("err") ** 2)), 6).alias("rmse")).withColumn("sensor", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


EXPLAIN_SQL = with_sql("gps", "baro", "starlink", more="e AS (SELECT 'baro' AS sensor, b.tr, b.u - g.u AS err FROM baro b ASOF JOIN gps g ON b.flight_id = g.flight_id AND b.tr >= g.tr UNION ALL SELECT 'starlink', s.tr, s.u - g.u FROM starlink s ASOF JOIN gps g ON s.flight_id = g.flight_id AND s.tr >= g.tr)") + (
    "SELECT sensor, CAST(floor(tr / 60) AS BIGINT) AS win, count(*) AS n, round(avg(err), 6) AS bias, round(sqrt(avg(err ** 2)), 6) AS rmse FROM e GROUP BY 1, 2"
)


def q_guardrails(spark: SparkSession, folder: str) -> DataFrame:
    """Two variants of the same samples side by side: as many rows, the same times, the largest difference and whether it is within 5 cm, per flight."""
    d = _samples(spark, folder)
    keys = ["flight_id", "matching_mode", "tr"]
    pick = lambda s: d.filter(F.col("series") == s).groupBy(*keys).agg(F.min("err_u").alias(s))
    j = pick("fused_raw_u").join(pick("fused_exported_u"), keys, "full")
    both = F.col("fused_raw_u").isNotNull() & F.col("fused_exported_u").isNotNull()
    most = F.max(F.abs(F.col("fused_raw_u") - F.col("fused_exported_u")))
    out = j.groupBy("flight_id", "matching_mode").agg(F.count("*").alias("times"), F.count_if(both).alias("shared"), F.count_if(F.col("fused_raw_u").isNull()).alias("only_exported"), F.round(most, 6).alias("most"))
    return out.withColumn("same", (F.col("times") == F.col("shared")) & F.coalesce(F.col("most") <= 0.05, F.lit(False)))


GUARD_SQL = f"""WITH {SAMPLES}, x AS (SELECT flight_id, matching_mode, tr, min(err_u) AS r FROM a WHERE series = 'fused_raw_u' GROUP BY ALL), y AS (SELECT flight_id, matching_mode, tr, min(err_u) AS e FROM a WHERE series = 'fused_exported_u' GROUP BY ALL),
z AS (SELECT flight_id, matching_mode, count(*) AS times, count(*) FILTER (r IS NOT NULL AND e IS NOT NULL) AS shared, count(*) FILTER (r IS NULL) AS only_exported, round(max(abs(r - e)), 6) AS most FROM x FULL JOIN y USING (flight_id, matching_mode, tr) GROUP BY ALL)
SELECT *, times = shared AND coalesce(most <= 0.05, FALSE) AS same FROM z"""


# The fields of a flow message, in order.
FLOW_MESSAGE = ["frame_idx", "stamp_ns", "t_sec", "dt_s", "flow_x_px_s_filt", "flow_y_px_s_filt", "dx_px_filt_equiv", "dy_px_filt_equiv", "flow_mag_filt",
                "quality_good_tracks_ratio", "n_good_tracks", "valid_filt", "is_bad_measurement", "outlier_score", "physical_bad", "mad_bad", "dt_bad", "quality_bad"]


def q_flow_message(spark: SparkSession, folder: str) -> DataFrame:
    """Flow frames as arrays of numbers in order of fields, missing numbers as NaN, under the stamp as it is after a double: its length, how many are missing, and the finite ones summed up in hundredths but for the stamp."""
    f = table(spark, folder, "lk_flow_physical_filtered").filter("stamp_ns IS NOT NULL").groupBy("flight_id", "frame_idx").agg(*(F.min(c).alias(c) for c in FLOW_MESSAGE[1:]))
    values = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in FLOW_MESSAGE))
    f = f.select("flight_id", "frame_idx", F.col("stamp_ns").cast("double").cast("bigint").alias("stamp"), values.alias("m"))
    known = F.filter("m", lambda x, i: finite(x) & (i != 1))
    return f.select("flight_id", "frame_idx", "stamp", F.size("m").alias("length"), F.size(F.filter("m", F.isnan)).alias("missing"), F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x * 100)).alias("hundredths"))


FLOW_MESSAGE_SQL = (
    f"WITH f AS (SELECT flight_id, frame_idx, {', '.join(f'min({c}) AS {c}' for c in FLOW_MESSAGE[1:])} FROM lk_flow_physical_filtered WHERE stamp_ns IS NOT NULL GROUP BY 1, 2) "
    "SELECT flight_id, frame_idx, CAST(CAST(stamp_ns AS DOUBLE) AS BIGINT) AS stamp, 18 AS length, "
    + " + ".join(f"CAST({c} IS NULL OR isnan(CAST({c} AS DOUBLE)) AS INT)" for c in FLOW_MESSAGE)
    + " AS missing, CAST("
    + " + ".join(f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN floor(CAST({c} AS DOUBLE) * 100) ELSE 0 END" for c in FLOW_MESSAGE if c != "stamp_ns")
    + " AS BIGINT) AS hundredths FROM f"
)


def q_velocity_events(spark: SparkSession, folder: str) -> DataFrame:
    """Velocity events to publish: valid rows within the speed bounds, one per nanosecond stamp (the last recorded)."""
    v = table(spark, folder, "vision_velocity_corrected_frd").filter(finite(F.col("t")) & finite(F.col("vx")) & finite(F.col("vy")) & finite(F.col("vz")))
    v = v.filter((F.hypot("vx", "vy") <= 60) & (F.abs("vz") <= 15)).withColumn("ns", F.rint(F.col("t") * 1e9).cast("bigint"))
    return v.groupBy("flight_id", "ns").agg(F.max("sample_id").alias("sample_id"), F.count("*").alias("rows"))


EVENTS_SQL = """SELECT flight_id, CAST(round(t * 1e9) AS BIGINT) AS ns, max(sample_id) AS sample_id, count(*) AS "rows" FROM vision_velocity_corrected_frd
WHERE isfinite(t) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND sqrt(vx ** 2 + vy ** 2) <= 60 AND abs(vz) <= 15 GROUP BY 1, 2"""


def q_velocity_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Second gate on velocities, forward and right: both within four robust sigmas of their centred median of 7, sigma over the whole flight."""
    d = in_blocks(vision(spark, folder).select("flight_id", "sample_id", "tr", "vx", "vy"), KEY, ["tr"], F.floor(F.col("tr") / 600), 3, 3)
    w = block_window(KEY).rowsBetween(-3, 3)
    d = owned(d.withColumns({f"res_{c}": F.col(f"v{c}") - F.percentile(f"v{c}", 0.5).over(w) for c in "xy"}))
    sides = d.select("flight_id", F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(f"res_{c}").alias("res")) for c in "xy"))).alias("r")).select("flight_id", "r.*")
    sigma = robust_sigma(sides, [*KEY, "axis"], "res").groupBy("flight_id").agg(*(F.max(F.when(F.col("axis") == c, F.col("sigma"))).alias(f"sigma_{c}") for c in "xy"))
    d = join_checked(d, cut(sigma), KEY)
    good = (F.abs("res_x") <= 4 * F.col("sigma_x")) & (F.abs("res_y") <= 4 * F.col("sigma_y"))
    return d.groupBy("flight_id").agg(F.count("*").alias("n"), F.round(F.max("sigma_x"), 6).alias("sigma_x"), F.round(F.max("sigma_y"), 6).alias("sigma_y"), F.count_if(good).alias("good"))


_SIGMA = "CASE WHEN count(*) >= 10 THEN CASE WHEN mad({r}) > 0 THEN 1.4826 * mad({r}) ELSE stddev_pop({r}) END END"
VELOCITY_GATE_SQL = with_sql("vision", more=f"""d AS (SELECT flight_id, vx - quantile_cont(vx, 0.5) OVER w AS rx, vy - quantile_cont(vy, 0.5) OVER w AS ry FROM vision WINDOW w AS (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT flight_id, {_SIGMA.format(r='rx')} AS sx, {_SIGMA.format(r='ry')} AS sy FROM d GROUP BY 1)""") + (
    "SELECT flight_id, count(*) AS n, round(max(sx), 6) AS sigma_x, round(max(sy), 6) AS sigma_y, count(*) FILTER (abs(rx) <= 4 * sx AND abs(ry) <= 4 * sy) AS good FROM d JOIN s USING (flight_id) GROUP BY 1"
)


def q_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a flight's inputs, one row per rule that it breaks."""
    b, s, v = (d.groupBy("flight_id").agg(F.count("*").alias(n), (F.max("tr") - F.min("tr")).alias(f"{n}_span")) for d, n in ((baro(spark, folder), "b"), (starlink(spark, folder), "s"), (vision(spark, folder), "v")))
    j = b.join(s, "flight_id", "full").join(v, "flight_id", "full").fillna(0)
    rules = F.array_compact(
        F.array(
            F.when(F.col("s") < 10, "few_sparse_fixes"),
            F.when(F.col("v") < F.col("b") / 2, "sparse_vision"),
            F.when(F.col("b_span") > 2 * F.col("v_span"), "vision_covers_little"),
            F.when(F.col("b") > 5 * F.col("b_span"), "dense_barometer"),
        )
    )
    return j.select("flight_id", F.explode(rules).alias("warning"))


WARNINGS_SQL = with_sql("baro", "starlink", "vision", more=", ".join(f"{n} AS (SELECT flight_id, count(*) AS {n}, max(tr) - min(tr) AS {n}_span FROM {t} GROUP BY 1)" for n, t in (("b", "baro"), ("s", "starlink"), ("v", "vision"))) + """,
j AS (SELECT flight_id, coalesce(b, 0) AS b, coalesce(b_span, 0) AS b_span, coalesce(s, 0) AS s, coalesce(v, 0) AS v, coalesce(v_span, 0) AS v_span FROM b FULL JOIN s USING (flight_id) FULL JOIN v USING (flight_id))""") + (
    "SELECT flight_id, 'few_sparse_fixes' AS warning FROM j WHERE s < 10 UNION ALL SELECT flight_id, 'sparse_vision' FROM j WHERE v < b / 2 UNION ALL SELECT flight_id, 'vision_covers_little' FROM j WHERE b_span > 2 * v_span UNION ALL SELECT flight_id, 'dense_barometer' FROM j WHERE b > 5 * b_span"
)


def q_late_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Vision rows by the lag between measurement and arrival: on time for their 0.2 s node (0.057 s after its end), or discarded."""
    v = vision(spark, folder).filter(finite(F.col("tr_arrival")))
    node_end = (F.floor(F.col("tr") / 0.2) + 1) * 0.2
    late = F.col("tr_arrival") > node_end + 0.057 + 1e-9
    return v.groupBy("flight_id").agg(F.count("*").alias("n"), F.count_if(late).alias("discarded"), F.round(F.max(F.col("tr_arrival") - F.col("tr")), 5).alias("most_lag"))


LATE_NODES_SQL = with_sql("vision") + (
    "SELECT flight_id, count(*) AS n, count(*) FILTER (tr_arrival > (floor(tr / 0.2) + 1) * 0.2 + 0.057 + 1e-9) AS discarded, round(max(tr_arrival - tr), 5) AS most_lag FROM vision WHERE isfinite(tr_arrival) GROUP BY 1"
)

QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and v.__module__ == __name__}
SQL = {
    "q_variant_compare": VARIANT_SQL,
    "q_window_decision": DECISION_SQL,
    "q_variant_windows": WINDOWS_SQL,
    "q_lobo_select": LOBO_SQL,
    "q_sign_permutation": PERMUTATION_SQL,
    "q_motion_start": MOTION_SQL,
    "q_start_velocity": START_SQL,
    "q_alignment_variants": VARIANTS_SQL,
    "q_sensor_explain": EXPLAIN_SQL,
    "q_guardrails": GUARD_SQL,
    "q_flow_message": FLOW_MESSAGE_SQL,
    "q_velocity_events": EVENTS_SQL,
    "q_velocity_gate": VELOCITY_GATE_SQL,
    "q_warnings": WARNINGS_SQL,
    "q_late_nodes": LATE_NODES_SQL,
}
