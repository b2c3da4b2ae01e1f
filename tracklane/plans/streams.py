"""Queries that run as Structured Streaming over the given tables, to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.operators.late_events import LateConfig
from tracklane.operators.recurrence import exponential
from tracklane.plans.problems import P6_MESSAGES
from tracklane.session import cut, forget, shared_folder
from tracklane.sources.tables import table
from tracklane.streaming.kernels import stream_sequential, time_slices
from tracklane.streaming.late import latest_periods, period_counts


def _drain(df: DataFrame, mode: str, at: str) -> None:
    """Run a stream until its input is used up; what it sends, batch by batch, goes to a table in the shared folder."""
    write = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/part={n}")
    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def _in_folder(spark: SparkSession, run: Callable[[str], None], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``read`` of what ``run`` sent to the folder it was given, which is deleted after."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        run(at)
        return cut(read(spark.read.parquet(f"{at}/out").drop("part")))
    finally:
        forget(spark, at)


def s_late_periods(spark: SparkSession, folder: str) -> DataFrame:
    """linear.x per flight and ten seconds of measurement time, each period as last corrected; files come one a batch, in whatever order, and a message counts once."""
    stored = table(spark, folder, "decoded_record")
    names = ["flight_id", "msg_seq", "rec_id", "header_stamp_ns", "bag_timestamp_ns"]
    first, last = stored.agg(F.min("bag_timestamp_ns"), F.max("bag_timestamp_ns")).first()
    span = 0 if first is None else (last - first) // 10**9  # stored files come in no order: the allowance is the whole span, so nothing is lost

    def run(at: str) -> None:
        # the star lets a table be a file as well as a folder of files
        m = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/decoded_record.parque*")
        m = m.select(*names, F.col("linear.x").alias("x"))
        _drain(period_counts(m, "flight_id", "msg_seq", "rec_id", "header_stamp_ns", "bag_timestamp_ns", "x", LateConfig(), span + 3600), "update", at)

    done = _in_folder(spark, run, lambda sent: latest_periods(sent, "flight_id"))
    return done.select("flight_id", F.col("period").alias("period_ns"), F.col("n").alias("messages"), "distinct", "lo", "hi", "median")


LATE_SQL = P6_MESSAGES + """SELECT flight_id, period_ns, count(*) AS messages, count(DISTINCT linear.x) AS "distinct", min(linear.x) AS lo, max(linear.x) AS hi, quantile_disc(linear.x, 0.5) AS median
FROM c WHERE late < 60000000000 AND isfinite(linear.x) GROUP BY 1, 2"""


def s_low_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Fused heights low-passed per flight and stretch of log in order of node, gaps held; the state lives in the stream, which gets the table in slices of time."""
    n = table(spark, folder, "synthetic_gps_5hz_gtsam_fixedlag").filter(F.col("tr").isNotNull() & ~F.isnan("tr"))
    n = n.select("flight_id", "seg", "idx", F.col("tr").alias("t"), F.when(~F.isnan("u"), F.col("u")).alias("x"))
    keys, order = ["flight_id", "seg"], ["t", "idx", "x"]

    def run(at: str) -> None:
        n.limit(0).write.parquet(f"{at}/in")
        stream = spark.readStream.schema(n.schema).parquet(f"{at}/in")
        # every copy of a node is read once: copies are alike or lack their value
        out = stream_sequential(stream, keys, order, _two_seconds, "y double")
        _drain(out, "append", at)
        for part in time_slices(n, keys, order, F.floor(F.col("t") / 600)):
            part.write.mode("append").parquet(f"{at}/in")
            _drain(out, "append", at)

    last = F.round(F.max(F.struct("t", "idx", F.col("x").isNotNull(), "x", "y"))["y"], 4)
    return _in_folder(spark, run, lambda sent: sent.groupBy(*keys).agg(F.count("*").alias("rows_read"), last.alias("last")))


LOW_PASS_SQL = """WITH RECURSIVE src AS (SELECT flight_id, seg, idx, tr AS t, CASE WHEN NOT isnan(u) THEN u END AS x FROM synthetic_gps_5hz_gtsam_fixedlag WHERE tr IS NOT NULL AND NOT isnan(tr)),
s AS (SELECT *, row_number() OVER (PARTITION BY flight_id, seg ORDER BY t, idx, x NULLS FIRST) AS i FROM src),
r AS (SELECT s.*, s.x AS y FROM s WHERE i = 1 UNION ALL
  SELECT s.*, CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x ELSE r.y + (1 - exp(-(s.t - r.t) / 2.0)) * (s.x - r.y) END
  FROM r JOIN s ON s.flight_id = r.flight_id AND s.seg = r.seg AND s.i = r.i + 1)
SELECT flight_id, seg, count(*) AS rows_read, round(arg_max(y, i), 4) AS last FROM r GROUP BY 1, 2"""


def _two_seconds(state: dict | None = None):
    return exponential(2.0, state)


QUERIES = {"s_late_periods": s_late_periods, "s_low_pass": s_low_pass}
SQL = {"s_late_periods": LATE_SQL, "s_low_pass": LOW_PASS_SQL}
