"""Queries of the problems that belong to this subpackage (1, 4, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.leakage import find_leaks
from tracklane.llm.mojibake import find_garbled
from tracklane.llm.nearest_time import nearest_in_time
from tracklane.llm.packing import PackConfig, pack
from tracklane.llm.quantiles import quantiles, summarise
from tracklane.operators.joins import join_checked
from tracklane.session import cut
from tracklane.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    good = F.col("tr").isNotNull() & (F.col("status") >= 0)
    fixes = table(spark, folder, "starlink_corrected_enu").filter(good)
    others = (
        ("gps_ref_enu", table(spark, folder, "gps_ref_enu").filter(good), "fix_id", 0.5),
        ("baro_corrected", table(spark, folder, "baro_corrected"), "sample_id", 0.2),
    )
    found = [
        nearest_in_time(fixes, other, "flight_id", "tr", "fix_id", other_id, tolerance).select(
            F.col("left_id").alias("fix_id"), F.lit(name).alias("other_table"), F.col("right_id").alias("other_id")
        )
        for name, other, other_id, tolerance in others
    ]
    return found[0].unionByName(found[1]).distinct()


def _nearest_sql(name: str, other_id: str, tolerance: float, good: str) -> str:
    return f"""SELECT fix_id, '{name}' AS other_table, oid AS other_id FROM (
  SELECT s.fix_id, o.oid, row_number() OVER (PARTITION BY s.fix_id ORDER BY abs(o.tr - s.tr), o.oid) AS rn
  FROM (SELECT fix_id, flight_id, tr FROM starlink_corrected_enu WHERE tr IS NOT NULL AND status >= 0) s
  JOIN (SELECT flight_id, tr, min({other_id}) AS oid FROM {name} WHERE tr IS NOT NULL {good} GROUP BY 1, 2) o
    ON o.flight_id = s.flight_id AND abs(o.tr - s.tr) <= {tolerance}) WHERE rn = 1"""


P1_SQL = _nearest_sql("gps_ref_enu", "fix_id", 0.5, "AND status >= 0") + " UNION ALL " + _nearest_sql("baro_corrected", "sample_id", 0.2, "")

PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
HEIGHT = {"series": ["series"], "matching_mode": ["matching_mode"], "series,matching_mode": ["series", "matching_mode"], "flight_id": ["flight_id"], "log_day": ["log_day"]}
BINS = {"bin_start_sec": ["bin_start_sec"], "run_name": ["run_name"], "matching_mode": ["matching_mode"]}
_P4 = (("fusion_height_aligned_samples", "err_u", HEIGHT), ("error_by_time_bin", "rmse_xy_m", BINS))


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of both columns per group of each dimension, with the ranks they may be off."""
    parts = [
        quantiles(summarise(table(spark, folder, t), v, dims), PROBS).select(F.lit(f"{t}.{v}").alias("measure"), "*") for t, v, dims in _P4
    ]
    return parts[0].unionByName(parts[1])


def p4_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    """Holds every percentile against the exact ranks of its value: n, and whether all are within their stated error."""
    out = None
    for t, v, dims in _P4:
        rows = table(spark, folder, t).filter(F.col(v).isNotNull() & ~F.isnan(v))
        answers = cut(quantiles(summarise(rows, v, dims), PROBS))
        answers = answers.groupBy("dimension", "group_key").agg(F.sort_array(F.collect_list(F.struct("q", "value", "rank_error", "n"))).alias("a"))
        key = lambda cs: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cs))
        for d, cs in dims.items():
            one = cut(answers.filter(F.col("dimension") == d).select(F.col("group_key").alias("_g"), "a"))
            seen = join_checked(rows.select(key(cs).alias("_g"), F.col(v).alias("v")), one, ["_g"], "inner")
            ranks = [F.count_if(F.col("v") < F.col("a")[i]["value"]).alias(f"lt{i}") for i in range(len(PROBS))]
            ranks += [F.count_if(F.col("v") <= F.col("a")[i]["value"]).alias(f"le{i}") for i in range(len(PROBS))]
            got = seen.groupBy("_g").agg(F.count("*").alias("n"), F.first("a").alias("a"), *ranks)
            ok = F.lit(True)
            for i in range(len(PROBS)):
                target = F.greatest(F.lit(1), F.ceil(F.col("a")[i]["q"] * F.col("n") - 1e-9))
                off = F.greatest(F.col(f"lt{i}") + 1 - target, target - F.col(f"le{i}"), F.lit(0))
                ok = ok & (off <= F.col("a")[i]["rank_error"]) & (F.col("a")[i]["rank_error"] <= 0.004 * F.col("n") + 1) & (F.col("a")[i]["n"] == F.col("n"))
            part = got.select(F.lit(f"{t}.{v}").alias("measure"), F.lit(d).alias("dimension"), F.col("_g").alias("group_key"), "n", ok.alias("within_error"))
            out = part if out is None else out.unionByName(part)
    return out


def _p4_check_sql() -> str:
    parts = []
    for t, v, dims in _P4:
        for d, cs in dims.items():
            key = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in cs)
            parts.append(
                f"SELECT '{t}.{v}' AS measure, '{d}' AS dimension, {key} AS group_key, count(*) AS n, TRUE AS within_error "
                f"FROM {t} WHERE {v} IS NOT NULL AND NOT isnan({v}) GROUP BY 3"
            )
    return " UNION ALL ".join(parts)


PACKING = PackConfig()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Where every notebook text goes, in containers of 2,048 tokens."""
    return pack(table(spark, folder, "documents"), "doc_id", "text", PACKING)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, per tenth of their capacity."""
    used = p8_containers(spark, folder).filter("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    tenth = F.least(F.floor(F.col("used") * 10 / PACKING.capacity), F.lit(9)).cast("int")
    return used.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the containers hold: texts, those placed with every token once and in order, containers over capacity or with room left between pieces, and whether there are no more containers than a tenth above the least possible."""
    plan = cut(p8_containers(spark, folder))
    cap = PACKING.capacity
    texts = plan.groupBy("doc_id").agg(
        F.count("*").alias("k"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"),
        F.count_if((F.col("start_token") != F.col("piece") * cap) | (F.col("n_tokens") > cap) | (F.col("container").isNull() != (F.col("n_tokens") == 0))).alias("wrong"),
    )
    whole = (F.col("wrong") == 0) & (F.col("k") == F.col("pieces")) & (F.col("last") + 1 == F.col("k")) & (F.col("n") == F.col("end"))
    texts = texts.agg(F.count("*").alias("texts"), F.count_if(whole).alias("placed_whole"), F.count_if(F.col("n") > 0).alias("with_tokens"))
    bins = plan.filter("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.countDistinct("offset").alias("offsets"), F.count("*").alias("k"))
    faulty = F.count_if((F.col("used") > cap) | (F.col("end") != F.col("used")) | (F.col("offsets") != F.col("k")))
    bins = bins.agg(faulty.alias("faulty_containers"), (F.count("*") <= F.ceil(F.sum("used") / cap) * 1.1 + 1).alias("near_least"))
    return texts.crossJoin(bins)  # a row each


P8_CHECK_SQL = "SELECT count(*) AS texts, count(*) AS placed_whole, count(*) FILTER (text <> '') AS with_tokens, 0 AS faulty_containers, TRUE AS near_least FROM documents"


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Where in each notebook an item stands, and how much of it."""
    return _leaks(spark, folder)


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder).select(F.col("doc").alias("doc_id")).distinct()


def p10_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled run, with the text it stood for where that can be told."""
    return _garbled(spark, folder)


QUERIES = {"p1_found": p1_found, "p4_percentiles": p4_percentiles, "p4_rank_check": p4_rank_check, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_runs": p10_runs}
SQL = {"p1_found": P1_SQL, "p4_rank_check": _p4_check_sql(), "p8_check": P8_CHECK_SQL}
