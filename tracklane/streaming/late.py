"""Problem 6 over a stream: value-count states per period, corrected as late records arrive in whatever order.

The state is kept per shard of messages, not per period: a message's first delivery is
known only when all its deliveries that are still to come have been looked at, and the
first one decides its period. Whatever a batch brings, a shard sends the value counts of
the periods it changed; the counts of a period's shards are added up where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.operators.late_events import LateConfig, measured_ns, period_stats, stamp

SHARD = 1024  # message numbers to a state
_STATE = "msg array<long>, rid array<long>, arrival array<long>, at array<long>, v array<double>"
_COLS = ["msg", "rid", "arrival", "at", "v"]


def period_counts(df: DataFrame, entity: str, message: str, row_id: str, header: str, arrival: str, value: str, cfg: LateConfig = LateConfig(), allowance_s: int = 86_400, shard: int = SHARD) -> DataFrame:
    """Of a stream of log entries: (entity, shard, period, v, n), the values of a shard's messages in a period and how often each was seen, sent again whenever a batch changes them.

    Of a message's entries the one of the least arrival counts, whichever comes first
    in the stream (of equals, the least row_id), so redelivered messages count once.
    Messages beyond the cut-off and missing values are in no count; an empty list says
    that a period has lost what it had. A null message number is a message of its own.
    A state is dropped, and an entry lost, only when the stream has seen a period whose
    cut-off is more than ``allowance_s`` later than its own: choose it wider than the
    stream's disorder.
    """
    at = measured_ns(F.col(header), F.col(arrival), cfg)
    rows = df.filter(stamp(F.col(arrival))).select(
        F.col(entity).alias("entity"),
        F.coalesce(F.col(message), F.lit(-(2**62))).alias("msg"),
        F.col(row_id).alias("rid"),
        F.col(arrival).alias("arrival"),
        at.alias("at"),
        F.col(value).cast("double").alias("v"),
    )
    due_us = F.expr(f"(at - pmod(at, {cfg.period_ns}) + {cfg.period_ns + cfg.cutoff_ns}) div 1000")
    rows = rows.select("*", F.floor(F.col("msg") / shard).alias("shard"), F.timestamp_micros(due_us).alias("due"))
    kind = dict(df.dtypes)[entity]

    def correct(key: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = pd.DataFrame(dict(zip(_COLS, state.get, strict=True)) if state.exists else {c: [] for c in _COLS})
        new = pd.concat([old, *(p[_COLS] for p in pdfs)]).astype({c: np.int64 for c in _COLS[:-1]} | {"v": float})
        new = new.sort_values(["msg", "arrival", "rid"]).drop_duplicates("msg")
        both = pd.concat([old.astype(new.dtypes), new]).drop_duplicates(_COLS, keep=False)  # what was there no longer, and what is new
        state.update(tuple(new[c].tolist() for c in _COLS))
        begin = lambda t: t["at"] - t["at"] % cfg.period_ns
        last_ms = int(begin(new).max() + cfg.period_ns + cfg.cutoff_ns) // 1_000_000
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs() + 1))
        kept = new[(new["arrival"] - begin(new) < cfg.period_ns + cfg.cutoff_ns) & np.isfinite(new["v"])]
        counts = {p: np.unique(g["v"], return_counts=True) for p, g in kept.groupby(begin(kept))}
        out = [(*key, int(p), *(x.tolist() for x in counts.get(p, (np.empty(0), np.empty(0))))) for p in begin(both).unique()]
        yield pd.DataFrame(out, columns=["entity", "shard", "period", "v", "n"])

    counted = rows.withWatermark("due", f"{allowance_s} seconds").groupBy("entity", "shard")
    sent = counted.applyInPandasWithState(correct, f"entity {kind}, shard long, period long, v array<double>, n array<long>", _STATE, "update", "EventTimeTimeout")
    return sent.withColumnRenamed("entity", entity)


def latest_periods(sent: DataFrame, entity: str, batch: str = "batch") -> DataFrame:
    """What ``period_counts`` sent, with the number of the batch: (entity, period, n, distinct, lo, hi, median) of each period as last corrected."""
    last = sent.groupBy(entity, "shard", "period").agg(F.max_by(F.struct("v", "n"), batch).alias("r"))
    rows = last.select(entity, "period", F.explode(F.arrays_zip("r.v", "r.n")).alias("c")).select(entity, "period", F.col("c.v").alias("v"), F.col("c.n").alias("k"))
    state = rows.groupBy(entity, "period", "v").agg(F.sum("k").alias("n_all")).withColumn("n_first", F.lit(0))
    names = ("n", "distinct", "lo", "hi", "median")
    return period_stats(state, [entity]).select(entity, "period", *(F.col(f"{c}_corrected").alias(c) for c in names))
