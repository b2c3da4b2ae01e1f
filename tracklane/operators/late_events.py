"""Aggregates per period of event time, corrected for late records (problem 6).

The state of a period is a multiset: how often each value was seen, apart for
records that were there when the period was first reported and for those that came
later, before the cut-off. Medians, distinct counts and extremes of either version
are read off the cumulative counts, so a correction is exact and needs no record
twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.missing import finite


@dataclass(frozen=True)
class LateConfig:
    period_ns: int = 10_000_000_000
    report_after_ns: int = 2_000_000_000  # a period is first reported so long after its end
    cutoff_ns: int = 60_000_000_000  # and corrected until then
    clock_slack_ns: int = 1_000_000_000  # a stamp further ahead of its arrival is wrong


def stamp(ns: Column) -> Column:
    """A time that sums and differences of nanoseconds can hold: within 126 years of 1970."""
    return F.coalesce(ns.between(-4 * 10**18, 4 * 10**18), F.lit(False))


def measured_ns(header: Column, arrival: Column, cfg: LateConfig = LateConfig()) -> Column:
    wrong = header.isNull() | (header == 0) | ~stamp(header) | (header > arrival + F.lit(cfg.clock_slack_ns))
    return F.when(wrong, arrival).otherwise(header)


def classify(
    df: DataFrame, message: list[str], row_id: str, header: str, arrival: str, carry: dict[str, Column] | None = None, cfg: LateConfig = LateConfig()
) -> DataFrame:
    """First delivery of each message with its period and outcome.

    Columns: message..., row_id, arrival, at_ns, period (start, ns), outcome
    ('in_time', 'corrects', 'dropped') and ``carry``. Of a message's rows the one of
    the least arrival counts (of equals, the least row_id); rows without an
    arrival (null, or no time within 126 years of 1970) never arrived and are left out; a null message key is a message like any other.
    """
    carry = carry or {}
    row = F.struct(
        F.col(arrival).alias("arrival"), F.col(row_id).alias("rid"), F.col(header).alias("header"), *(c.alias(f"c{i}") for i, c in enumerate(carry.values()))
    )
    order = F.struct(F.col(arrival), F.col(row_id))
    first = df.filter(stamp(F.col(arrival))).groupBy(*message).agg(F.min_by(row, order).alias("r"))
    at = measured_ns(F.col("r.header"), F.col("r.arrival"), cfg)
    period = at - F.pmod(at, F.lit(cfg.period_ns))
    late = F.col("arrival") - (F.col("period") + F.lit(cfg.period_ns))
    out = first.select(
        *message, F.col("r.rid").alias(row_id), F.col("r.arrival").alias("arrival"), at.alias("at_ns"), period.alias("period"), *(F.col(f"r.c{i}").alias(n) for i, n in enumerate(carry))
    )
    return out.withColumn(
        "outcome", F.when(late >= cfg.cutoff_ns, "dropped").when(late >= cfg.report_after_ns, "corrects").otherwise("in_time")
    )


def value_counts(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The state: (keys..., period, v, n_first, n_all). Missing and non-finite values are not counted; dropped records neither."""
    kept = events.filter((F.col("outcome") != "dropped") & finite(F.col(value)))
    return kept.groupBy(*keys, "period", F.col(value).alias("v")).agg(
        F.count_if(F.col("outcome") == "in_time").alias("n_first"), F.count("*").alias("n_all")
    )


def merge_counts(*states: DataFrame) -> DataFrame:
    """States of several days or runs added up."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    keys = [c for c in both.columns if c not in ("n_first", "n_all")]
    return both.groupBy(*keys).agg(F.sum("n_first").alias("n_first"), F.sum("n_all").alias("n_all"))


def period_stats(state: DataFrame, keys: list[str]) -> DataFrame:
    """First and corrected version of each period: n, distinct, lo, hi, median (the lower of two middle values)."""
    w = Window.partitionBy(*keys, "period").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys, "period")
    s = state
    for n in ("first", "all"):
        s = s.withColumn(f"cum_{n}", F.sum(f"n_{n}").over(w)).withColumn(f"sum_{n}", F.sum(f"n_{n}").over(total))
    aggs = []
    for n, label in (("first", "first"), ("all", "corrected")):
        has = F.col(f"n_{n}") > 0
        aggs += [
            F.sum(f"n_{n}").alias(f"n_{label}"),
            F.count_if(has).alias(f"distinct_{label}"),
            F.min(F.when(has, F.col("v"))).alias(f"lo_{label}"),
            F.max(F.when(has, F.col("v"))).alias(f"hi_{label}"),
            F.min(F.when(has & (F.col(f"cum_{n}") * 2 >= F.col(f"sum_{n}")), F.col("v"))).alias(f"median_{label}"),
        ]
    return s.groupBy(*keys, "period").agg(*aggs)
