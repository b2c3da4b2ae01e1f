"""Checks of a data folder before work begins, and typed reads of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns that the sensor queries need.
REQUIRED = {
    "gps_ref_enu": {"fix_id": "bigint", "flight_id": "bigint", "tr": "double", "e": "double", "n": "double", "u": "double", "status": "int"},
    "starlink_corrected_enu": {"fix_id": "bigint", "flight_id": "bigint", "tr": "double", "u": "double", "status": "int"},
    "baro_corrected": {"sample_id": "bigint", "flight_id": "bigint", "tr": "double", "u_corr": "double", "alt": "double"},
    "vision_velocity_corrected_frd": {"sample_id": "bigint", "flight_id": "bigint", "tr": "double", "vx": "double", "vy": "double", "vz": "double"},
    "lk_flow_physical_filtered": {"flight_id": "bigint", "frame_idx": "bigint", "stamp_ns": "bigint", "flow_x_px_s_filt": "double"},
    "decoded_record": {"rec_id": "bigint", "flight_id": "bigint", "msg_seq": "bigint", "bag_timestamp_ns": "bigint", "linear": "struct<x:double,y:double,z:double>"},
}


def violations(spark: SparkSession, folder: str, required: dict[str, dict[str, str]] = REQUIRED) -> DataFrame:
    """(table, column, problem) of each missing table or column, wrong type and empty table; nothing if all is well."""
    from pyspark.errors import AnalysisException

    found = []
    for name, columns in required.items():
        try:
            df = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            found.append((name, "", "missing table"))
            continue
        have = dict(df.dtypes)
        found += [(name, c, "missing column" if c not in have else f"is {have[c]}, not {t}") for c, t in columns.items() if have.get(c) != t]
        if df.isEmpty():
            found.append((name, "", "empty"))
    return spark.createDataFrame(found, '`table` string, `column` string, problem string')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, of known types; cells that don't fit become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_json(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """JSON of known types, a document a file (or, without ``whole_files``, a line); what does not fit becomes null."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "PERMISSIVE").json(path)
