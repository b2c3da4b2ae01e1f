"""Percentiles of very large columns with a known rank error, to be combined at will (problem 4).

A summary is a sorted list of values, each with the interval (rmin, rmax) its rank
lies in. One of a partition's rows is exact; merging adds up intervals and
loses nothing; compressing keeps the values nearest to evenly spaced ranks, which
widens the gap between neighbours by what the capacity permits. The gaps that are
left give the error of any later answer, so it is known and not only estimated.
Summaries are rows of a table: those of other days or partitions are merged with it
by a union and ``merge_summaries``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.functions.missing import present

CAPACITY = 1000  # values a summary keeps; each compression errs by n / (2 * capacity) ranks at most
BUFFER = 500_000  # values held in a task before they are summarised
FAN_IN = 32
ROUNDS = 3
SUMMARY = "dimension string, group_key string, slot long, n long, v array<double>, rmin array<long>, rmax array<long>"

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def exact(values: np.ndarray) -> Summary:
    """Each distinct value with the interval of ranks it holds: its first and last are known, so both are kept where they differ."""
    v = np.sort(values)
    rank = np.arange(1, len(v) + 1)
    return v, rank, rank.copy()


def merge(a: Summary, b: Summary) -> Summary:
    """Ranks of a value among both: its own plus where the other summary says it falls."""
    (av, al, ah), (bv, bl, bh) = a, b

    def within(v: np.ndarray, ov: np.ndarray, ol: np.ndarray, oh: np.ndarray, after_equal: bool) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(ov, v, side="right" if after_equal else "left")
        low = np.where(k > 0, ol[np.maximum(k - 1, 0)], 0)
        high = np.where(k < len(ov), oh[np.minimum(k, len(ov) - 1)] - 1, oh[-1])
        return low, high

    if not len(av) or not len(bv):
        return a if len(av) else b
    lo_a, hi_a = within(av, bv, bl, bh, False)  # of equal values those of a come first
    lo_b, hi_b = within(bv, av, al, ah, True)
    v = np.concatenate([av, bv])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([al + lo_a, bl + lo_b])[order], np.concatenate([ah + hi_a, bh + hi_b])[order]


def compress(s: Summary, n: int, capacity: int = CAPACITY) -> Summary:
    """At most ``capacity`` values: the extremes and those nearest to evenly spaced ranks."""
    v, lo, hi = s
    if len(v) <= capacity:
        return s
    wanted = np.linspace(1, n, capacity)
    mid = (lo + hi) / 2
    k = np.clip(np.searchsorted(mid, wanted), 1, len(v) - 1)
    k = np.where(wanted - mid[k - 1] <= mid[k] - wanted, k - 1, k)
    k[0], k[-1] = 0, len(v) - 1
    k = np.unique(k)
    return v[k], lo[k], hi[k]


def answer(s: Summary, n: int, q: float) -> tuple[float, int]:
    """A value for quantile q and by how many ranks it may be off (rank ceil(q n), the first at least)."""
    v, lo, hi = s
    r = max(1, int(np.ceil(q * n - 1e-9)))
    off = np.maximum(np.maximum(r - lo, hi - r), 0)
    i = int(np.argmin(off))
    return float(v[i]), int(off[i])


def _row(dim: str, key: str, slot: int, n: int, s: Summary) -> dict:
    """A summary as a row; of one that holds every value the ranks go without saying and are left empty."""
    v, lo, hi = s
    if len(v) == n:
        lo = hi = np.empty(0, np.int64)
    return {"dimension": dim, "group_key": key, "slot": slot, "n": n, "v": v, "rmin": lo, "rmax": hi}


def _of(row) -> Summary:
    v = np.asarray(row.v, float)
    if len(v) == row.n:
        return v, np.arange(1, len(v) + 1), np.arange(1, len(v) + 1)
    return v, np.asarray(row.rmin, np.int64), np.asarray(row.rmax, np.int64)


def _summarise(batches: Iterator[pa.RecordBatch], dims: list[str], capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    slot, held, size = TaskContext.get().partitionId(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        t = pd.concat(held)
        rows = []
        for d in dims:
            for key, v in t.groupby(d, dropna=False, sort=False)["value"]:
                x = v.to_numpy(float)
                rows.append(_row(d, None if pd.isna(key) else key, slot, len(x), compress(exact(x), len(x), capacity)))
        schema = pa.schema(
            [("dimension", pa.string()), ("group_key", pa.string()), ("slot", pa.int64()), ("n", pa.int64())]
            + [("v", pa.list_(pa.float64())), ("rmin", pa.list_(pa.int64())), ("rmax", pa.list_(pa.int64()))]
        )
        yield from pa.Table.from_pylist(rows, schema=schema).to_batches(max_chunksize=256)

    for b in batches:
        held.append(b.to_pandas())
        size += b.num_rows
        if size >= BUFFER:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _merge_rows(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    parts = [_of(r) for r in pdf.itertuples()]
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    n, first = int(pdf["n"].sum()), pdf.iloc[0]
    return pd.DataFrame([_row(first["dimension"], first["group_key"], int(first["slot"]), n, compress(parts[0], n, capacity))])


def merge_summaries(summaries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One summary per dimension and group, merged over ROUNDS levels of at most FAN_IN slots each."""
    s = summaries.withColumn("slot", F.pmod(F.col("slot"), F.lit(FAN_IN**ROUNDS)))
    for _ in range(ROUNDS):
        s = s.withColumn("slot", F.floor(F.col("slot") / FAN_IN))
        s = s.groupBy("dimension", "group_key", "slot").applyInPandas(partial(_merge_rows, capacity=capacity), SUMMARY)
    return s


def summarise(df: DataFrame, value: str, dimensions: dict[str, list[str]], capacity: int = CAPACITY) -> DataFrame:
    """Summaries (SUMMARY) of ``value`` for every group of every dimension (a name and its columns), one pass over df.

    Null and NaN values are left out, infinities are values; group columns are
    joined by '|', a null among them is the text 'null'. Repeated rows count
    repeatedly. No rows give no summaries.
    """
    text = lambda cs: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cs))
    rows = df.filter(present(F.col(value))).select(*(text(cs).alias(d) for d, cs in dimensions.items()), F.col(value).cast("double").alias("value"))
    parts = rows.mapInArrow(partial(_summarise, dims=list(dimensions), capacity=capacity), SUMMARY)
    return merge_summaries(parts, capacity)


def _answers(batches: Iterator[pd.DataFrame], probs: list[float]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            s = _of(r)
            rows += [(r.dimension, r.group_key, int(r.n), q, *answer(s, int(r.n), q)) for q in probs]
        yield pd.DataFrame(rows, columns=["dimension", "group_key", "n", "q", "value", "rank_error"])


def quantiles(summaries: DataFrame, probs: list[float]) -> DataFrame:
    """(dimension, group_key, n, q, value, rank_error) of merged summaries."""
    return summaries.mapInPandas(partial(_answers, probs=probs), "dimension string, group_key string, n long, q double, value double, rank_error long")
