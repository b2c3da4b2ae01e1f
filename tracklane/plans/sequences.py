"""Queries of filters and estimators that carry a state."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions.missing import finite
from tracklane.operators.align import asof, neighbours
from tracklane.operators.frames import block_window, in_blocks, last_known, owned
from tracklane.operators.recurrence import bias_ewma, bias_kalman, confidence_over_gaps, exponential_gain, kalman_over_gaps, low_pass, rational_gain, sequential
from tracklane.operators.smoother import smooth_heights
from tracklane.plans.alignment import KEY, r6
from tracklane.session import cut
from tracklane.sources.sensors import baro, flow, starlink, vision, with_sql
from tracklane.sources.tables import table


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Barometer heights with their gaps: the first row of each time, whatever it holds."""
    b = table(spark, folder, "baro_corrected").filter(finite(F.col("tr")))
    b = b.groupBy("flight_id", "tr").agg(F.min("sample_id").alias("sample_id"), F.min_by(F.struct("u_corr"), "sample_id").alias("r"))
    return b.select("flight_id", "tr", "sample_id", F.when(finite(F.col("r.u_corr")), F.col("r.u_corr")).alias("x"))


def q_iir_exp(spark: SparkSession, folder: str) -> DataFrame:
    """Height low-passed with gain 1 - exp(-dt / 0.8): gaps hold, what comes before the first value stays empty."""
    out = low_pass(_gappy(spark, folder), KEY, "tr", ["sample_id"], "x", exponential_gain(0.8))
    return out.select("flight_id", "sample_id", F.round("y", 5).alias("y"))


def _recursive(source: str, order: str, first: str, step: str, cols: str) -> str:
    """Rows of a series one after the other: first state, and state from the row before (r) and this one (s)."""
    return f"""WITH RECURSIVE src AS ({source}), s AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY {order}) AS i FROM src),
r AS (SELECT s.*, {first} FROM s WHERE i = 1 UNION ALL SELECT s.*, {step} FROM r JOIN s ON s.flight_id = r.flight_id AND s.i = r.i + 1) SELECT {cols} FROM r"""


IIR_EXP_SQL = _recursive(
    """SELECT flight_id, tr, sample_id, CASE WHEN isfinite(u_corr) THEN u_corr END AS x FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, tr ORDER BY sample_id) AS rn
  FROM baro_corrected WHERE isfinite(tr)) WHERE rn = 1""",
    "tr",
    "s.x AS y",
    "CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x ELSE r.y + (1 - exp(-(s.tr - r.tr) / 0.8)) * (s.x - r.y) END",
    "flight_id, sample_id, round(y, 5) AS y",
)


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return flow(spark, folder).filter("t_sec IS NOT NULL").select("flight_id", "frame_idx", F.col("t_sec").alias("t"), F.col("flow_x_px_s_filt").alias("x"), (F.coalesce("is_bad_measurement", F.lit(1.0)) > 0).alias("bad"))


_FRAMES_SQL = with_sql("flow") + "SELECT flight_id, frame_idx, t_sec AS t, flow_x_px_s_filt AS x, coalesce(is_bad_measurement, 1) > 0 AS bad FROM flow WHERE t_sec IS NOT NULL"
TAU_2HZ = 1 / (2 * math.pi * 2.0)


def q_iir_rational(spark: SparkSession, folder: str) -> DataFrame:
    """Flow low-passed at 2 Hz from zero, gain dt / (tau + dt)."""
    out = low_pass(_frames(spark, folder), KEY, "t", ["frame_idx"], "x", rational_gain(TAU_2HZ), seed=0.0)
    return out.select("flight_id", "frame_idx", F.round("y", 5).alias("y"))


IIR_RATIONAL_SQL = _recursive(
    _FRAMES_SQL,
    "t, frame_idx",
    "CAST(0.0 AS DOUBLE) AS y",
    f"CASE WHEN s.x IS NULL THEN r.y ELSE r.y + greatest(1e-4, s.t - r.t) / ({TAU_2HZ} + greatest(1e-4, s.t - r.t)) * (s.x - r.y) END",
    "flight_id, frame_idx, round(y, 5) AS y",
)


def q_hold_decay(spark: SparkSession, folder: str) -> DataFrame:
    """Bad or missing flow replaced by the last good one, held for half a second and then decaying: what is held follows from the last good frame and how long ago it was."""
    good = F.when(~F.col("bad") & F.col("x").isNotNull(), F.struct("t", "x"))
    out = last_known(_frames(spark, folder), KEY, ["t", "frame_idx"], good, "g")
    held = F.col("t") - F.col("g.t")
    y = F.when(held <= 0.5, F.col("g.x")).otherwise(F.col("g.x") * F.exp(-(held - 0.5) / 0.5))
    return out.select("flight_id", "frame_idx", F.round(F.coalesce(y, F.lit(0.0)), 5).alias("y"))


HOLD_SQL = _recursive(
    _FRAMES_SQL,
    "t, frame_idx",
    "CASE WHEN s.bad OR s.x IS NULL THEN 0.0 ELSE s.x END AS good, CAST(0.0 AS DOUBLE) AS held",
    "CASE WHEN s.bad OR s.x IS NULL THEN r.good ELSE s.x END, CASE WHEN s.bad OR s.x IS NULL THEN r.held + greatest(s.t - r.t, 0) ELSE 0.0 END",
    "flight_id, frame_idx, round(CASE WHEN held <= 0.5 THEN good ELSE good * exp(-(held - 0.5) / 0.5) END, 5) AS y",
)


def _speed(spark: SparkSession, folder: str) -> DataFrame:
    """Horizontal vision speed: trailing median of 25, then trailing mean of 25."""
    v = vision(spark, folder).select("flight_id", "tr", F.hypot("vx", "vy").alias("s"))
    d = in_blocks(v, KEY, ["tr"], F.floor(F.col("tr") / 600), 48, 0)
    w = block_window(KEY).rowsBetween(-24, 0)
    return owned(d.withColumn("m", F.percentile("s", 0.5).over(w)).withColumn("speed", F.avg("m").over(w))).select("flight_id", "tr", "speed")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse fixes with the barometer height and the speed before them; fixes before the first height are no events."""
    s = starlink(spark, folder).select("flight_id", "fix_id", "tr", "u")
    d = asof(s, baro(spark, folder).select("flight_id", "tr", F.col("u").alias("source")), KEY, "tr", ["source"]).drop("age").filter("source IS NOT NULL")
    return asof(d, _speed(spark, folder), KEY, "tr", ["speed"]).drop("age")


_SPEED_SQL = """m AS (SELECT flight_id, tr, quantile_cont(sqrt(vx ** 2 + vy ** 2), 0.5) OVER w AS m FROM vision WINDOW w AS (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)),
sp AS (SELECT flight_id, tr, avg(m) OVER (PARTITION BY flight_id ORDER BY tr ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS speed FROM m),
ev AS (SELECT s.flight_id, s.fix_id, s.tr, s.u, b.u AS source FROM starlink s ASOF JOIN baro b ON s.flight_id = b.flight_id AND s.tr >= b.tr)"""


def q_bias_ewma(spark: SparkSession, folder: str) -> DataFrame:
    """The barometer's bias against the sparse fixes: gated at 6 m, clipped at 3 m, time constant 30 s."""
    out = sequential(_events(spark, folder), KEY, ["tr"], bias_ewma, "m double, inn double, accepted boolean, bias double")
    return out.select("flight_id", "fix_id", r6("m"), r6("inn"), "accepted", r6("bias"))


EWMA_SQL = _recursive(
    with_sql("baro", "starlink", "vision", more=_SPEED_SQL) + "SELECT flight_id, fix_id, tr, source - u AS m FROM ev",
    "tr",
    "m AS inn, CASE WHEN abs(m) <= 6 THEN (1 - exp(-10.0 / 30)) * greatest(-3, least(3, m)) ELSE 0.0 END AS bias",
    "s.m - r.bias, r.bias + CASE WHEN abs(s.m - r.bias) <= 6 THEN (1 - exp(-(s.tr - r.tr) / 30)) * greatest(-3, least(3, s.m - r.bias)) ELSE 0.0 END",
    "flight_id, fix_id, round(m, 6) AS m, round(inn, 6) AS inn, abs(inn) <= 6 AS accepted, round(bias, 6) AS bias",
)


def q_bias_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Barometer heights less the bias known at their time."""
    trace = sequential(_events(spark, folder), KEY, ["tr"], bias_ewma, "m double, inn double, accepted boolean, bias double")
    d = asof(baro(spark, folder).select("flight_id", "sample_id", "tr", "u"), trace.select("flight_id", "tr", "bias"), KEY, "tr", ["bias"])
    return d.select("flight_id", "sample_id", F.round(F.col("u") - F.coalesce("bias", F.lit(0.0)), 5).alias("u"))


CORRECTED_SQL = f"""WITH trace AS (SELECT flight_id, tr, bias FROM ({EWMA_SQL.replace("SELECT flight_id, fix_id, round(m, 6) AS m, round(inn, 6) AS inn, abs(inn) <= 6 AS accepted, round(bias, 6) AS bias FROM r", "SELECT flight_id, tr, bias FROM r")})),
{with_sql("baro")[5:]} SELECT b.flight_id, b.sample_id, round(b.u - coalesce(t.bias, 0), 5) AS u FROM baro b ASOF LEFT JOIN trace t ON b.flight_id = t.flight_id AND b.tr >= t.tr"""


def q_bias_kalman(spark: SparkSession, folder: str) -> DataFrame:
    """Bias and gain on squared speed of the barometer, by a gated two-state Kalman filter over the sparse fixes."""
    d = _events(spark, folder).filter("speed IS NOT NULL")
    out = sequential(d, KEY, ["tr"], bias_kalman, "m double, inn double, accepted boolean, bias double, gain double")
    return out.select("flight_id", "fix_id", F.round("inn", 5).alias("inn"), "accepted", F.round("bias", 5).alias("bias"), F.round("gain", 5).alias("gain"))


def _kalman_step(x0: str, x1: str, p0: str, p1: str, p2: str) -> str:
    """State and covariance (p0 p1; p1 p2, with the walk added) after s, as a struct."""
    inn = f"(s.m - ({x0} + {x1} * s.f))"
    h0, h1 = f"({p0} + {p1} * s.f)", f"({p1} + {p2} * s.f)"
    v = f"({h0} + s.f * {h1} + 2.25)"
    c = f"greatest(-3, least(3, {inn}))"
    ok = f"abs({inn}) <= 10"
    return (
        f"{{'inn': {inn}, 'x0': CASE WHEN {ok} THEN greatest(-8, least(8, {x0} + {h0} / {v} * {c})) ELSE {x0} END, 'x1': CASE WHEN {ok} THEN greatest(0, least(12, {x1} + {h1} / {v} * {c})) ELSE {x1} END, "
        f"'p0': CASE WHEN {ok} THEN {p0} - {h0} * {h0} / {v} ELSE {p0} END, 'p1': CASE WHEN {ok} THEN {p1} - {h0} * {h1} / {v} ELSE {p1} END, 'p2': CASE WHEN {ok} THEN {p2} - {h1} * {h1} / {v} ELSE {p2} END}}"
    )


_DT = "(s.tr - r.tr)"
KALMAN_SQL = _recursive(
    with_sql("baro", "starlink", "vision", more=_SPEED_SQL) + "SELECT ev.flight_id, fix_id, ev.tr, source - u AS m, (speed / 10) ** 2 AS f FROM ev ASOF JOIN sp ON ev.flight_id = sp.flight_id AND ev.tr >= sp.tr",
    "tr",
    _kalman_step("0.0", "0.0", "(16 + 0.01 * 10)", "0.0", "(16 + 0.0004 * 10)") + " AS k",
    _kalman_step("r.k.x0", "r.k.x1", f"(r.k.p0 + 0.01 * {_DT})", "r.k.p1", f"(r.k.p2 + 0.0004 * {_DT})"),
    "flight_id, fix_id, round(k.inn, 5) AS inn, abs(k.inn) <= 10 AS accepted, round(k.x0, 5) AS bias, round(k.x1, 5) AS gain",
)


REVERT, WALK = (60.0, 240.0), (0.2, 0.02)
TRUST = {"least": 3, "keep": 5, "most": 5.0, "spread": 2.0, "rise": 10.0}
FALL, AGE = 3.0, 20.0


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return asof(baro(spark, folder).select("flight_id", "tr", "sample_id", "u"), _speed(spark, folder), KEY, "tr", ["speed"]).drop("age")


def _reverting(spark: SparkSession, folder: str, samples: DataFrame) -> DataFrame:
    """State of the mean-reverting filter after each event; between events it is predicted to every sample, which is summed up per gap beforehand."""
    events = cut(_events(spark, folder).select("flight_id", "tr", "u", "source", "speed"))
    usable = events.filter("speed IS NOT NULL")
    steps = samples.select("flight_id", "tr", F.lit(1).alias("side")).unionByName(events.select("flight_id", "tr", F.when(F.col("speed").isNull(), 1).otherwise(0).alias("side")))
    steps = in_blocks(steps, KEY, ["tr", "side"], F.floor(F.col("tr") / 600), 1, 0)
    steps = owned(steps.withColumn("dt", F.coalesce(F.col("tr") - F.lag("tr").over(block_window(KEY)), F.lit(0.0)))).drop("pos")
    steps = neighbours(steps, usable.select("flight_id", "tr"), KEY, "tr", [])
    steps = steps.withColumn("at", F.when(F.col("side") == 0, F.col("tr")).otherwise(F.col("next.tr"))).filter("at IS NOT NULL")
    grown = lambda i: F.sum(WALK[i] ** 2 * F.col("dt") * F.exp(-2 * (F.col("at") - F.col("tr")) / REVERT[i])).alias(f"grown{i}")
    gaps = steps.groupBy("flight_id", F.col("at").alias("tr")).agg(F.sum("dt").alias("since"), grown(0), grown(1))
    kernel = partial(kalman_over_gaps, revert=REVERT)
    return sequential(usable.join(gaps, ["flight_id", "tr"]), KEY, ["tr"], kernel, "m double, inn double, accepted boolean, bias double, gain double")


def _with_error(samples: DataFrame, trace: DataFrame) -> DataFrame:
    """Samples with the error that the filter has at their time: the state after the last event, reverting since."""
    d = asof(samples, trace.select("flight_id", "tr", "bias", "gain"), KEY, "tr", ["bias", "gain"])
    now = lambda c, tau: F.coalesce(F.col(c) * F.exp(-F.col("age") / tau), F.lit(0.0))
    return d.withColumn("total", now("bias", REVERT[0]) + now("gain", REVERT[1]) * (F.coalesce("speed", F.lit(0.0)) / 10) ** 2).drop("bias", "gain", "age")


def q_bias_reverting(spark: SparkSession, folder: str) -> DataFrame:
    """Barometer heights less the error of the mean-reverting filter at their time."""
    samples = cut(_samples(spark, folder))
    d = _with_error(samples, _reverting(spark, folder, samples))
    return d.select("flight_id", "sample_id", F.round(F.col("u") - F.col("total"), 5).alias("u"), F.round("total", 5).alias("error"))


def q_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the correction is trusted (three of the last five fixes within 2 m), and the capped part of it that is applied."""
    samples = cut(_samples(spark, folder))
    trace = cut(_reverting(spark, folder, samples))
    after = asof(samples.select("flight_id", "tr"), trace.select("flight_id", "tr", F.col("tr").alias("te")), KEY, "tr", ["te"]).filter("te IS NOT NULL")
    fresh = F.max(F.when(F.col("age") <= AGE, F.col("tr")))
    after = after.groupBy("flight_id", F.col("te").alias("tr")).agg(F.max("tr").alias("last"), fresh.alias("last_fresh"))
    rows = trace.join(after, ["flight_id", "tr"], "left").select("flight_id", "tr", "accepted", "inn", "m", "last", "last_fresh")
    known = sequential(rows, KEY, ["tr"], partial(confidence_over_gaps, fall=FALL, age=AGE, **TRUST), "c double, up boolean")
    d = asof(_with_error(samples, trace), known.select("flight_id", "tr", "c", "up", "last_fresh"), KEY, "tr", ["c", "up", "last_fresh"])
    te = F.col("tr") - F.col("age")
    turn = F.when(~F.col("up"), te).when(F.col("age") <= AGE, F.col("tr")).otherwise(F.coalesce("last_fresh", te))
    risen = F.when(F.col("up"), 1 + (F.col("c") - 1) * F.exp(-(turn - te) / TRUST["rise"])).otherwise(F.col("c"))
    trust = F.coalesce(risen * F.exp(-(F.col("tr") - turn) / FALL), F.lit(0.0))
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), trust))
    applied = trust * F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.col("total")))
    return d.select("flight_id", "sample_id", F.round(trust, 5).alias("trust"), (F.round(applied, 5) + 0.0).alias("applied"))


def _reverting_step(x0: str, x1: str, p0: str, p1: str, p2: str, dt: str) -> str:
    """State after s as a struct, from one predicted over dt; without a measurement as predicted."""
    a, b = f"exp(-({dt}) / {REVERT[0]})", f"exp(-({dt}) / {REVERT[1]})"
    p0, p1, p2 = f"({p0} * {a} * {a} + {WALK[0] ** 2} * ({dt}))", f"({p1} * {a} * {b})", f"({p2} * {b} * {b} + {WALK[1] ** 2} * ({dt}))"
    x0, x1 = f"({x0} * {a})", f"({x1} * {b})"
    step = _kalman_step(x0, x1, p0, p1, p2)
    rest = f"{{'inn': CAST(NULL AS DOUBLE), 'x0': {x0}, 'x1': {x1}, 'p0': {p0}, 'p1': {p1}, 'p2': {p2}}}"
    return f"CASE WHEN s.m IS NULL THEN {rest} ELSE {step} END"


_ORDERED = with_sql("baro", "starlink", "vision", more=_SPEED_SQL) + """SELECT ev.flight_id, ev.tr, 0 AS side, fix_id AS id, ev.u, CASE WHEN speed IS NOT NULL THEN source - ev.u END AS m, (speed / 10) ** 2 AS f
FROM ev ASOF LEFT JOIN sp ON ev.flight_id = sp.flight_id AND ev.tr >= sp.tr
UNION ALL SELECT b.flight_id, b.tr, 1, sample_id, b.u, NULL, (coalesce(speed, 0) / 10) ** 2 FROM baro b ASOF LEFT JOIN sp ON b.flight_id = sp.flight_id AND b.tr >= sp.tr"""
_STATES = _recursive(
    _ORDERED,
    "tr, side",
    _reverting_step("0.0", "0.0", "16.0", "0.0", "16.0", "0.0") + " AS k",
    _reverting_step("r.k.x0", "r.k.x1", "r.k.p0", "r.k.p1", "r.k.p2", "s.tr - r.tr"),
    "flight_id, tr, side, id, u, m, k.inn AS inn, abs(k.inn) <= 10 AS accepted, k.x0 + k.x1 * f AS total",
)
REVERTING_SQL = f"SELECT flight_id, id AS sample_id, round(u - total, 5) AS u, round(total, 5) AS error FROM ({_STATES}) WHERE side = 1"
_SEEN = "CASE WHEN s.accepted AND abs(s.inn) <= 5 THEN list_slice(list_append({seen}, s.m), -5, -1) ELSE []::DOUBLE[] END"
_MAD = "list_median(list_transform({x}, lambda v: abs(v - list_median({x}))))"


def _trust_step(c: str, up: str, since: str, seen: str, dt: str) -> str:
    """Trust, whether it rises, since when, and the last biases after s. ``since``: the last event that let it rise."""
    new = _SEEN.format(seen=seen)
    up_now = f"CASE WHEN s.side = 1 AND (s.tr - {since} > {AGE}) THEN FALSE ELSE {up} END"
    c_now = f"CASE WHEN {up_now} THEN {c} + (1 - exp(-({dt}) / 10.0)) * (1 - {c}) ELSE {c} * exp(-({dt}) / {FALL}) END"
    stable = f"(s.side = 0 AND len({new}) >= 3 AND {_MAD.format(x=new)} <= 2)"
    return f"{{'c': {c_now}, 'up': CASE WHEN s.side = 0 THEN {stable} ELSE {up_now} END, 'since': CASE WHEN {stable} THEN s.tr ELSE {since} END, 'seen': CASE WHEN s.side = 0 THEN {new} ELSE {seen} END}}"


CONFIDENCE_SQL = _recursive(
    f"SELECT * FROM ({_STATES}) WHERE side = 1 OR m IS NOT NULL",
    "tr, side",
    _trust_step("CAST(0.0 AS DOUBLE)", "FALSE", "CAST(-1e18 AS DOUBLE)", "[]::DOUBLE[]", "0.0") + " AS k",
    _trust_step("r.k.c", "r.k.up", "r.k.since", "r.k.seen", "s.tr - r.tr"),
    "flight_id, id AS sample_id, round(greatest(0.0, least(1.0, k.c)), 5) AS trust, round(greatest(0.0, least(1.0, k.c)) * greatest(-2.5, least(2.5, total)), 5) + 0.0 AS applied, side",
)
CONFIDENCE_SQL = f"SELECT flight_id, sample_id, trust, applied FROM ({CONFIDENCE_SQL}) WHERE side = 1"


def q_smoother(spark: SparkSession, folder: str) -> DataFrame:
    """Height and climb at 5 Hz nodes from barometer and sparse fixes, smoothed with a lag of 20 s."""
    b = baro(spark, folder).select("flight_id", "seg", "tr", F.col("u").alias("z"), F.lit(1.5).alias("sigma"), F.lit(0).alias("kind"))
    s = starlink(spark, folder).select("flight_id", "seg", "tr", F.col("u").alias("z"), F.lit(100.0).alias("sigma"), F.lit(1).alias("kind"))
    out = smooth_heights(b.unionByName(s))
    return out.select("flight_id", "seg", "node", F.round("u", 5).alias("u"), F.round("vu", 5).alias("vu"), F.round("sigma_u", 5).alias("sigma_u"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_") and v.__module__ == __name__}
SQL = {
    "q_iir_exp": IIR_EXP_SQL,
    "q_iir_rational": IIR_RATIONAL_SQL,
    "q_hold_decay": HOLD_SQL,
    "q_bias_ewma": EWMA_SQL,
    "q_bias_corrected": CORRECTED_SQL,
    "q_bias_kalman": KALMAN_SQL,
    "q_bias_reverting": REVERTING_SQL,
    "q_confidence": CONFIDENCE_SQL,
}
