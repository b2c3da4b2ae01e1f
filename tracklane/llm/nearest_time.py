"""Pair each record with the nearest record in time of the same entity (problem 1).

Both tables are sharded by entity and stretch of time, so that an entity with very
many records is spread over many tasks; right records near a border are also given
to the shard beyond it, as far as the tolerance reaches. Inside a partition the
records of a shard come in time order, and a merge iterator keeps the last right
record before the current position and the left records that still wait for the
next one, none of them further back than the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.functions.missing import finite

_RESULT = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("gap", pa.float64())])


class _Merge:
    """The iterator's state: one shard's neighbouring right record and waiting left records."""

    def __init__(self, tolerance: float) -> None:
        self.tolerance = tolerance
        self.key = None
        self.start(None)

    def start(self, key: tuple | None) -> None:
        self.key = key
        self.right = (-np.inf, 0)
        self.wait = np.empty((0,)), np.empty((0,), np.int64), np.empty((0,)), np.empty((0,), np.int64)

    def decide(self, t, i, bt, bi, at, ai) -> pa.RecordBatch:
        """Left (t, i) between right (bt, bi) and (at, ai): the nearer, of equals the one of the smaller id."""
        before, after = t - bt, at - t
        use_after = (after < before) | ((after == before) & (ai < bi))
        gap, j = np.where(use_after, after, before), np.where(use_after, ai, bi)
        hit = gap <= self.tolerance
        return pa.RecordBatch.from_arrays([pa.array(i[hit]), pa.array(j[hit].astype(np.int64)), pa.array(gap[hit])], schema=_RESULT)

    def run(self, t: np.ndarray, i: np.ndarray, is_right: np.ndarray) -> list[pa.RecordBatch]:
        """The next rows of the current shard, in time order (right records first among equals)."""
        n, out = len(t), []
        pos = np.arange(n)
        last = np.maximum.accumulate(np.where(is_right, pos, -1))
        nxt = np.minimum.accumulate(np.where(is_right, pos, n)[::-1])[::-1]
        left = ~is_right
        lt, li, lb, la = t[left], i[left], last[left], nxt[left]
        bt = np.where(lb >= 0, t[lb], self.right[0])
        bi = np.where(lb >= 0, i[lb], self.right[1])
        wt, wi, wbt, wbi = (np.concatenate(x) for x in zip(self.wait, (lt, li, bt, bi), strict=True))
        la = np.concatenate([np.full(len(self.wait[0]), nxt[0] if n else 0), la])
        done = la < n
        if done.any():
            out.append(self.decide(wt[done], wi[done], wbt[done], wbi[done], t[la[done]], i[la[done]]))
        gone = ~done & (t[-1] - wt > self.tolerance)
        out += self.close(wt[gone], wi[gone], wbt[gone], wbi[gone])
        keep = ~done & ~gone
        self.wait = wt[keep], wi[keep], wbt[keep], wbi[keep]
        if last[-1] >= 0:
            self.right = t[last[-1]], i[last[-1]]
        return out

    def close(self, t=None, i=None, bt=None, bi=None) -> list[pa.RecordBatch]:
        """Left records that no right record follows near enough."""
        t, i, bt, bi = self.wait if t is None else (t, i, bt, bi)
        return [self.decide(t, i, bt, bi, np.full(len(t), np.inf), np.zeros(len(t), np.int64))] if len(t) else []


def _merge(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    m = _Merge(tolerance)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        e, shard = b.column("e"), b.column("shard")
        t, i = b.column("t").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False)
        right = b.column("side").to_numpy(zero_copy_only=False) == 0
        changes = pc.or_(pc.not_equal(e.slice(1), e.slice(0, n - 1)), pc.not_equal(shard.slice(1), shard.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = (e[a].as_py(), shard[a].as_py())
            if key != m.key:
                yield from m.close()
                m.start(key)
            yield from m.run(t[a:z], i[a:z], right[a:z])
    yield from m.close()


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, time: str, left_id: str, right_id: str, tolerance: float, shard: float = 600.0
) -> DataFrame:
    """(left_id, right_id, gap): of each left record the nearest right one of its entity, where it is at most ``tolerance`` away.

    Ids are BIGINT, times numbers. Of right records at one time the smallest id
    counts; of two equally far ones too. Records whose id, entity or time is
    missing (null; NaN or infinite time) pair with nothing; a left record without a partner
    has no row; repeated left records each have theirs; an empty side gives an empty
    result. Other columns of either table are ignored. ``shard`` is at least twice
    the tolerance.
    """
    if shard < 2 * tolerance:
        raise ValueError("shard must be at least twice the tolerance")
    reach = tolerance * (1 + 1e-9) + 1e-9
    of = lambda t: F.floor(t / shard)

    def rows(df: DataFrame, id_: str) -> DataFrame:
        t = F.col(time).cast("double")
        return df.filter(F.col(entity).isNotNull() & F.col(id_).isNotNull() & finite(t)).select(F.col(entity).alias("e"), t.alias("t"), F.col(id_).cast("bigint").alias("id"))

    t = F.col("t")
    r = rows(right, right_id).groupBy("e", "t").agg(F.min("id").alias("id"))
    r = r.withColumn("shard", F.explode(F.array_distinct(F.array(of(t), of(t - reach), of(t + reach))))).withColumn("side", F.lit(0))
    both = r.unionByName(rows(left, left_id).withColumn("shard", of(t)).withColumn("side", F.lit(1)))
    placed = both.repartition("e", "shard").sortWithinPartitions("e", "shard", "t", "side", "id")
    return placed.mapInArrow(partial(_merge, tolerance=tolerance), "left_id bigint, right_id bigint, gap double")
