"""Queries of the general problems (2, 3, 5, 6, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions.missing import finite
from tracklane.operators.copy_diff import Field, diff_copies
from tracklane.operators.late_events import classify, period_stats, value_counts
from tracklane.operators.regular_grid import regular_grid
from tracklane.operators.spikes import flag_readings
from tracklane.operators.units import RADIANS, SPELLINGS, to_radians, unit_of
from tracklane.sources.tables import table

FLOW_FIELDS = [
    Field("stamp_ns", "stamp"),
    *map(
        Field,
        (
            "t_sec", "dt_s", "flow_x_px_s_filt", "flow_y_px_s_filt", "dx_px_filt_equiv", "dy_px_filt_equiv",
            "flow_mag_filt", "quality_good_tracks_ratio", "n_good_tracks", "valid_filt", "is_bad_measurement",
            "outlier_score", "physical_bad", "mad_bad", "dt_bad", "quality_bad",
        ),
    ),
]
TWIST_FIELDS = [
    Field("header_stamp_ns", "stamp"),
    *(Field(f"{v}.{c}") for v in ("linear", "angular") for c in "xyz"),
    Field("frame_id", "text"),
]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = (
        ("flow", "lk_flow_physical_filtered", "lk_flow_golden", "frame_idx", FLOW_FIELDS),
        ("twist", "decoded_record", "twist_golden", "msg_seq", TWIST_FIELDS),
    )
    found = [
        diff_copies(table(spark, folder, a), table(spark, folder, b), "flight_id", key, fields).select(
            F.lit(name).alias("dataset"), F.col("entity").alias("flight_id"), "row_key", "diff", "field_name"
        )
        for name, a, b, key, fields in parts
    ]
    return found[0].unionByName(found[1])


def _diff_sql(dataset: str, a: str, b: str, key: str, fields: list[Field]) -> str:
    names = [f'"{f.path.replace(".", "__")}"' for f in fields]

    def side(t: str) -> str:
        cols = ", ".join(
            (f"CASE WHEN isnan({f.path}) THEN NULL ELSE {f.path} END" if f.kind == "number" else f.path) + f" AS {n}"
            for f, n in zip(fields, names, strict=True)
        )
        return f"SELECT DISTINCT flight_id, {key} AS k, {cols} FROM {t}"

    def differs(f: Field, n: str) -> str:
        x, y = f"a.{n}", f"b.{n}"
        if f.kind == "text":
            return f"{x} IS DISTINCT FROM {y}"
        far = f"abs({x} - {y}) > 1024" if f.kind == "stamp" else f"CASE WHEN {x} = {y} THEN FALSE ELSE abs({x} - {y}) > 0.001 END"
        return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NOT ({x} IS NULL AND {y} IS NULL) ELSE {far} END"

    on = "a.flight_id = b.flight_id AND a.k = b.k"
    head = f"SELECT '{dataset}' AS dataset,"
    parts = [
        f"{head} a.flight_id, a.k AS row_key, 'missing_in_golden' AS diff, '' AS field_name FROM ({side(a)}) a ANTI JOIN ({side(b)}) b ON {on}",
        f"{head} b.flight_id, b.k, 'missing_in_generated', '' FROM ({side(b)}) b ANTI JOIN ({side(a)}) a ON {on}",
    ]
    parts += [
        f"{head} a.flight_id, a.k, 'value', '{f.path}' FROM ({side(a)}) a JOIN ({side(b)}) b ON {on} WHERE {differs(f, n)}"
        for f, n in zip(fields, names, strict=True)
    ]
    return " UNION ALL ".join(parts)


P2_SQL = (
    _diff_sql("flow", "lk_flow_physical_filtered", "lk_flow_golden", "frame_idx", FLOW_FIELDS)
    + " UNION ALL "
    + _diff_sql("twist", "decoded_record", "twist_golden", "msg_seq", TWIST_FIELDS)
)


def _angles(spark: SparkSession, folder: str) -> DataFrame:
    return to_radians(table(spark, folder, "euler_raw"), "sample_id", ["flight_id", "origin"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _angles(spark, folder).filter(F.col("unit") != "rad").select("sample_id", "unit").distinct()


def p3_radians(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that hold angles, in radians."""
    return _angles(spark, folder)


def p3_stated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold angles as numbers and name their unit in the unit column: these three in radians."""
    e = table(spark, folder, "euler_raw").withColumn("names", unit_of(F.col("angle_unit")))
    d = to_radians(e.filter(F.col("names").isNotNull() & (finite(F.col("roll")) | finite(F.col("pitch")) | finite(F.col("yaw")))), "sample_id", ["flight_id", "origin"])
    return d.select("sample_id", "unit", "unit_from", *(F.round(f"{c}_rad", 6).alias(c) for c in ("roll", "pitch", "yaw")))


def _stated_sql() -> str:
    words = ", ".join(f"('{w}', '{u}', {RADIANS[u]!r}::DOUBLE)" for u, ws in SPELLINGS.items() for w in ws)
    rad = lambda c: f"CASE WHEN isfinite({c}) THEN {c} * f END"
    return f"""WITH w AS (SELECT * FROM (VALUES {words}) v(word, unit, f)), e AS (SELECT sample_id, unit, {rad('roll')} AS roll, {rad('pitch')} AS pitch, {rad('yaw')} AS y
  FROM euler_raw JOIN w ON lower(regexp_replace(angle_unit, '\\s', '', 'g')) = word WHERE isfinite(roll) OR isfinite(pitch) OR isfinite(yaw))
SELECT sample_id, unit, 'row' AS unit_from, round(roll, 6) AS roll, round(pitch, 6) AS pitch, round(y - 2 * pi() * floor((y + pi()) / (2 * pi())), 6) AS yaw FROM e"""


MESSAGE = ["flight_id", "msg_seq"]


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    carry = {"topic": F.col("topic"), "x": F.col("linear.x")}
    return classify(table(spark, folder, "decoded_record"), MESSAGE, "rec_id", "header_stamp_ns", "bag_timestamp_ns", carry)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).filter(F.col("outcome") != "in_time").select("rec_id", "outcome")


def p6_periods(spark: SparkSession, folder: str) -> DataFrame:
    """linear.x per flight, topic and ten seconds of measurement time, as first reported and as corrected."""
    keys = ["flight_id", "topic"]
    stats = period_stats(value_counts(_messages(spark, folder), keys, "x"), keys)
    return stats.select(
        *keys,
        F.col("period").alias("period_ns"),
        *(f"{c}_{v}" for v in ("first", "corrected") for c in ("n", "distinct", "lo", "hi", "median")),
    )


P6_MESSAGES = """
WITH f AS (
  SELECT *, row_number() OVER (PARTITION BY flight_id, msg_seq ORDER BY bag_timestamp_ns, rec_id) AS rn
  FROM decoded_record WHERE bag_timestamp_ns IS NOT NULL),
m AS (
  SELECT *, CASE WHEN header_stamp_ns IS NULL OR header_stamp_ns = 0 OR header_stamp_ns > bag_timestamp_ns + 1000000000
    THEN bag_timestamp_ns ELSE header_stamp_ns END AS at_ns FROM f WHERE rn = 1),
c AS (
  SELECT *, at_ns - at_ns % 10000000000 AS period_ns,
    bag_timestamp_ns - (at_ns - at_ns % 10000000000 + 10000000000) AS late FROM m)
"""
P6_FOUND_SQL = (
    P6_MESSAGES
    + "SELECT rec_id, CASE WHEN late >= 60000000000 THEN 'dropped' ELSE 'corrects' END AS outcome FROM c WHERE late >= 2000000000"
)
_first = "FILTER (late < 2000000000)"
P6_PERIODS_SQL = (
    P6_MESSAGES
    + f"""SELECT flight_id, topic, period_ns,
  count(*) {_first} AS n_first, count(DISTINCT linear.x) {_first} AS distinct_first,
  min(linear.x) {_first} AS lo_first, max(linear.x) {_first} AS hi_first, quantile_disc(linear.x, 0.5) {_first} AS median_first,
  count(*) AS n_corrected, count(DISTINCT linear.x) AS distinct_corrected,
  min(linear.x) AS lo_corrected, max(linear.x) AS hi_corrected, quantile_disc(linear.x, 0.5) AS median_corrected
FROM c WHERE late < 60000000000 AND linear.x IS NOT NULL AND isfinite(linear.x) GROUP BY ALL"""
)

SERIES = (
    ("baro_u_corr", "baro_corrected", "u_corr"),
    ("vision_vx", "vision_velocity_corrected_frd", "vx"),
    ("fusion_u", "synthetic_gps_5hz_gtsam_fixedlag", "u"),
)


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, t).select(F.lit(name).alias("series"), "flight_id", "seg", "tr", F.col(v).cast("double").alias("v")) for name, t, v in SERIES
    ]
    return regular_grid(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["series", "flight_id", "seg"], "tr", "v")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder).filter(F.col("status") != "read").select("series", "flight_id", "seg", "cell")


def p7_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The regular series: a value per second, read, filled (gaps of up to five cells) or marked as a gap."""
    return _grid(spark, folder).withColumn("value", F.round("value", 6))


_P7_CELLS = (
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS series, flight_id, seg, tr, {v} AS v FROM {t}" for n, t, v in SERIES)
    + """),
c AS (SELECT series, flight_id, seg, CAST(floor(tr) AS BIGINT) AS cell, count(*) AS n, avg(v) AS v FROM r
  WHERE tr IS NOT NULL AND isfinite(tr) AND v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
g AS (SELECT series, flight_id, seg, unnest(generate_series(min(cell), max(cell))) AS cell FROM c GROUP BY series, flight_id, seg),
j AS (SELECT g.*, c.n, c.v FROM g LEFT JOIN c USING (series, flight_id, seg, cell))
"""
)
P7_FOUND_SQL = _P7_CELLS + "SELECT series, flight_id, seg, cell FROM j WHERE n IS NULL"
P7_GRID_SQL = (
    _P7_CELLS
    + """, w AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN {'cell': cell, 'v': v} END IGNORE NULLS) OVER a AS p,
    first_value(CASE WHEN n IS NOT NULL THEN {'cell': cell, 'v': v} END IGNORE NULLS) OVER b AS q FROM j
  WINDOW a AS (PARTITION BY series, flight_id, seg ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY series, flight_id, seg ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, CASE WHEN n IS NOT NULL THEN 'read' WHEN q.cell - p.cell <= 6 AND isfinite(p.v) AND isfinite(q.v) THEN 'filled' ELSE 'gap' END AS status FROM w)
SELECT series, flight_id, seg, cell, coalesce(n, 0) AS n, status, p.cell AS last_cell, q.cell AS next_cell,
  round(CASE WHEN status = 'read' THEN v WHEN status = 'filled' THEN p.v + (q.v - p.v) * ((cell - p.cell) / (q.cell - p.cell)) END, 6) AS value
FROM s"""
)

# What no sensor of the kind can have measured.
BOUNDS = {
    "alt": (-500.0, 9000.0),
    "flow_x_px_s_filt": (-20000.0, 20000.0),
    "outlier_score": (0.0, float("inf")),
    "linear.x": (-100.0, 100.0),
}
CHECKED = (
    ("baro_corrected", "alt", "sample_id", "t", ("flight_id",)),
    ("lk_flow_physical_filtered", "flow_x_px_s_filt", "frame_idx", "frame_idx", ("flight_id",)),
    ("lk_flow_physical_filtered", "outlier_score", "frame_idx", "frame_idx", ("flight_id",)),
    ("decoded_record", "linear.x", "rec_id", "msg_seq", ("flight_id", "topic")),
)


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of a flagged reading: table_name, flight_id, row_key, field_name, kind."""
    rows = None
    for t, field, row_key, order, source in CHECKED:
        part = table(spark, folder, t).select(
            F.lit(t).alias("table_name"),
            "flight_id",
            F.col(row_key).alias("row_key"),
            F.lit(field).alias("f"),
            F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in source)).alias("src"),
            F.col(order).cast("double").alias("ord"),
            F.col(field).cast("double").alias("v"),
        )
        rows = part if rows is None else rows.unionByName(part)
    flags = flag_readings(rows.select("f", "src", "ord", "v"), F.floor(F.col("ord") / 1000), BOUNDS)
    held = rows.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return held.join(flags, ["f", "src", "ord"]).select("table_name", "flight_id", "row_key", F.col("f").alias("field_name"), "kind")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).drop("kind").distinct()


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each flight were flagged, by kind."""
    return _flagged(spark, folder).groupBy("table_name", "field_name", "flight_id", "kind").agg(F.countDistinct("row_key").alias("n"))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_radians": p3_radians,
    "p3_stated": p3_stated,
    "p5_found": p5_found,
    "p5_kinds": p5_kinds,
    "p6_found": p6_found,
    "p6_periods": p6_periods,
    "p7_found": p7_found,
    "p7_grid": p7_grid,
}
SQL = {"p2_found": P2_SQL, "p3_stated": _stated_sql(), "p6_found": P6_FOUND_SQL, "p6_periods": P6_PERIODS_SQL, "p7_found": P7_FOUND_SQL, "p7_grid": P7_GRID_SQL}
