"""Sensor series made ready: valid rows, finite times, one row per time (the first recorded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions.missing import finite
from tracklane.operators.units import to_radians
from tracklane.sources.tables import table


def one_per_key(df: DataFrame, keys: list[str], *order: str, last: bool = False) -> DataFrame:
    """The first (or last) row by ``order`` of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def all_finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & finite(F.col(c))
    return out


def valid_fix() -> Column:
    """A fix with a position that is not the zero one and a status that is not an error."""
    return (F.col("status") >= 0) & all_finite("lat", "lon", "alt") & ~((F.col("lat") == 0) & (F.col("lon") == 0))


def gps(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "gps_ref_enu").filter(valid_fix() & all_finite("tr", "e", "n", "u"))
    return one_per_key(df.select("flight_id", "tr", "fix_id", "seg", "t", "lat", "lon", "alt", "e", "n", "u"), ["flight_id", "tr"], "fix_id")


def starlink(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "starlink_corrected_enu").filter(valid_fix() & all_finite("tr", "e", "n", "u"))
    return one_per_key(df.select("flight_id", "tr", "fix_id", "seg", "t", "e", "n", "u"), ["flight_id", "tr"], "fix_id")


def baro(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "baro_corrected").filter(all_finite("tr", "u_corr"))
    return one_per_key(df.select("flight_id", "tr", "sample_id", "seg", "t", F.col("u_corr").alias("u")), ["flight_id", "tr"], "sample_id")


def vision(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "vision_velocity_corrected_frd").filter(all_finite("tr", "vx", "vy", "vz"))
    return one_per_key(df.select("flight_id", "tr", "sample_id", "seg", "t", "tr_arrival", "vx", "vy", "vz"), ["flight_id", "tr"], "sample_id")


def attitude(spark: SparkSession, folder: str, *angles: str) -> DataFrame:
    """Attitudes that hold all of ``angles``, in radians whatever unit they were recorded in (problem 3); ``unsure``: the unit is a guess from the size of the stream's values, and a doubtful one."""
    df = table(spark, folder, "euler_raw").withColumn("at", F.struct("sample_id", "tr"))
    df = to_radians(df, "at", ["flight_id", "origin"]).filter(finite(F.col("at.tr")) & all_finite(*(f"{a}_rad" for a in angles)))
    df = df.select("flight_id", "at.tr", "at.sample_id", *(F.col(f"{a}_rad").alias(a) for a in angles), F.col("uncertain").alias("unsure"))
    return one_per_key(df, ["flight_id", "tr"], "sample_id")


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """Optical-flow frames, exact repeats dropped, infinite and NaN numbers as null."""
    df = table(spark, folder, "lk_flow_physical_filtered")
    number = lambda c: F.when(finite(F.col(c)), F.col(c)).alias(c)
    names = ["t_sec", "dt_s", "flow_x_px_s_filt", "flow_y_px_s_filt", "flow_mag_filt", "quality_good_tracks_ratio", "n_good_tracks", "valid_filt", "is_bad_measurement"]
    df = df.select("flight_id", "frame_idx", "seg", "stamp_ns", *map(number, names))
    return df.groupBy("flight_id", "frame_idx").agg(F.min(F.struct(*df.columns[2:])).alias("r")).select("flight_id", "frame_idx", "r.*")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Twist messages, each as first delivered (of equal arrivals the least rec_id)."""
    df = table(spark, folder, "decoded_record").select(
        "flight_id", "msg_seq", "rec_id", "topic", "bag_timestamp_ns", "header_stamp_ns", *(F.col(f"{v}.{c}").alias(f"{v[0]}{c}") for v in ("linear", "angular") for c in "xyz"), "frame_id"
    )
    return one_per_key(df.filter(F.col("bag_timestamp_ns").isNotNull()), ["flight_id", "msg_seq"], "bag_timestamp_ns", "rec_id")


# The same in SQL, as common table expressions.
_FIX = "status >= 0 AND isfinite(lat) AND isfinite(lon) AND isfinite(alt) AND NOT (lat = 0 AND lon = 0) AND isfinite(tr) AND isfinite(e) AND isfinite(n) AND isfinite(u)"


def _one(select: str, source: str, where: str, keys: str, order: str) -> str:
    return f"SELECT * EXCLUDE (rn) FROM (SELECT {select}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1"


SQL = {
    "gps": _one("flight_id, tr, fix_id, seg, t, lat, lon, alt, e, n, u", "gps_ref_enu", _FIX, "flight_id, tr", "fix_id"),
    "starlink": _one("flight_id, tr, fix_id, seg, t, e, n, u", "starlink_corrected_enu", _FIX, "flight_id, tr", "fix_id"),
    "baro": _one("flight_id, tr, sample_id, seg, t, u_corr AS u", "baro_corrected", "isfinite(tr) AND isfinite(u_corr)", "flight_id, tr", "sample_id"),
    "vision": _one(
        "flight_id, tr, sample_id, seg, t, tr_arrival, vx, vy, vz", "vision_velocity_corrected_frd", "isfinite(tr) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz)", "flight_id, tr", "sample_id"
    ),
    "flow": "SELECT DISTINCT flight_id, frame_idx, seg, stamp_ns, "
    + ", ".join(
        f"CASE WHEN isfinite({c}) THEN {c} END AS {c}"
        for c in ("t_sec", "dt_s", "flow_x_px_s_filt", "flow_y_px_s_filt", "flow_mag_filt", "quality_good_tracks_ratio", "n_good_tracks", "valid_filt", "is_bad_measurement")
    )
    + " FROM lk_flow_physical_filtered",
    "messages": _one(
        "flight_id, msg_seq, rec_id, topic, bag_timestamp_ns, header_stamp_ns, linear.x AS lx, linear.y AS ly, linear.z AS lz, angular.x AS ax, angular.y AS ay, angular.z AS az, frame_id",
        "decoded_record", "bag_timestamp_ns IS NOT NULL", "flight_id, msg_seq", "bag_timestamp_ns, rec_id",
    ),
}


def with_sql(*names: str, more: str = "") -> str:
    """WITH clause of the named series, and further expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " + more if more else "") + " "
