"""Implausible readings per source: spikes, stuck values, impossible values (problem 5).

A hidden Markov model per source has the states normal, spike, stuck and
out-of-range. What it sees of a reading is its distance from the level of its
neighbours (the nearest of the medians before, after and around it, so that a
lasting change of level is near the level after it; with and without the local
slope), in units of the source's own scatter, whether it repeats the reading before
it, and whether it is within hard bounds. Stuck is a state of least duration: a chain
of ``stuck_run`` - 1 repeats, of which the last may go on, so that shorter runs
cannot be stuck and, as a normal reading is never taken to repeat with more than
``most_repeats``, longer ones are. How often a source spikes or leaves its bounds is
its own rate. Forward-backward gives state probabilities; spikes and stuck readings
follow from them, out-of-range from the bounds.

A source is cut by row position into blocks with a halo on either side, so that a
long source is spread over many tasks and a decision never needs more than the halo;
a task runs the model over many chunks of its blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.missing import finite, present
from tracklane.operators.joins import join_checked
from tracklane.operators.positions import with_positions
from tracklane.session import cut


@dataclass(frozen=True)
class SpikeConfig:
    side: int = 5  # neighbours on each side that make the level
    stuck_run: int = 20
    halo: int = 48
    chunk: int = 256
    block_chunks: int = 64  # chunks to a block; a block lies in one task
    scatter_quantile: float = 0.8  # of the distances; what an exponential 0.9 quantile would be from it is one scatter
    tail: float = 0.75  # of the normal state's exponential distances, in scatters
    spike_from: float = 3.0  # spikes spread log-evenly between these, in scatters
    spike_to: float = 1e5
    spike_rates: tuple[float, float] = (0.001, 0.004)  # bounds of a source's own rate
    stay_spike: float = 0.3
    enter_stuck: float = 0.0005
    stay_stuck: float = 0.97
    most_repeats: float = 0.3
    out_rates: tuple[float, float] = (0.0005, 0.05)
    stay_out: float = 0.3
    bin_ratio: float = 1.005  # of the histogram that the scatter is read from


def _median_of(windows: np.ndarray) -> np.ndarray:
    """Median over the last axis, NaN left out; NaN where nothing is left."""
    n = (~np.isnan(windows)).sum(-1)
    s = np.sort(windows, axis=-1)  # NaN last
    at = lambda i: np.take_along_axis(s, np.maximum(i, 0)[..., None], -1)[..., 0]
    return np.where(n > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


def distances(x: np.ndarray, side: int) -> np.ndarray:
    """Distance from the level of the neighbours, of rows of readings (NaN: not usable); NaN where there is none.

    Levels are medians of the readings before, after and around, as they are and
    carried along the neighbourhood's slope (its median step); the nearest counts.
    """
    pad = np.pad(x, [(0, 0), (side, side)], constant_values=np.nan)
    w = np.lib.stride_tricks.sliding_window_view(pad, 2 * side + 1, axis=1)
    slope = np.nan_to_num(_median_of(np.diff(w, axis=-1)))
    levels = []
    for v in (w, w - slope[..., None] * np.arange(-side, side + 1)):
        before, after = v[..., :side], v[..., side + 1 :]
        levels += [_median_of(before), _median_of(after), _median_of(np.concatenate([before, after], -1))]
    gap = np.abs(x[..., None] - np.stack(levels, -1))
    gap[np.isnan(gap)] = np.inf
    r = gap.min(-1)
    return np.where(np.isinf(r), np.nan, r)


def run_lengths(x: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of identical values each reading is in, and whether it is the run's first; runs end with their block."""
    first = np.r_[True, (x[1:] != x[:-1]) | (block[1:] != block[:-1])][: len(x)]
    run = np.cumsum(first) - 1
    return np.bincount(run)[run] if len(x) else run, first


def posterior(z: np.ndarray, same: np.ndarray, out: np.ndarray, absent: np.ndarray, repeats: np.ndarray, spikes: np.ndarray, outs: np.ndarray, cfg: SpikeConfig) -> np.ndarray:
    """State probabilities (lanes, steps, 4: normal, spike, stuck, out) by forward-backward, all lanes at once.

    ``same``: the reading repeats the one before it. Per lane, ``repeats`` is how often
    a normal reading does, ``spikes`` and ``outs`` how often one is followed by these.
    """
    lanes, steps = z.shape
    z = np.nan_to_num(z, nan=0.0, posinf=cfg.spike_to)
    e = np.empty((steps, 4, lanes))  # states: normal, spike, out; any of the stuck chain
    normal = np.exp(-z / cfg.tail) / cfg.tail
    again = np.clip(repeats, 0.001, cfg.most_repeats)[:, None]
    again = np.where(same, again, 1 - again)
    e[:, 0] = (normal * again).T
    e[:, 1] = (np.where(z > cfg.spike_from, 1 / (np.maximum(z, cfg.spike_from) * np.log(cfg.spike_to / cfg.spike_from)), 1e-9) * again).T
    e[:, 2] = 1e-12
    e[:, 3] = np.where(same, 1 / cfg.tail, 0.0).T
    e[:, :3] += 1e-15
    e.transpose(0, 2, 1)[out.T] = (1e-12, 1e-12, 1.0, 0.0)
    e.transpose(0, 2, 1)[absent.T] = 1.0
    k = cfg.stuck_run - 1  # links of the chain
    stay = 1 - spikes - cfg.enter_stuck - outs
    f = np.empty((steps, 4, lanes))
    a, c = np.array([[0.98], [0.01], [0.005]]) * np.ones(lanes), np.zeros((k, lanes))
    c[-1] = 0.005  # the beginning may lie in a run
    chain = np.empty((steps, k, lanes))
    for i in range(steps):
        if i:
            back = a[0]
            c = np.concatenate([(back * cfg.enter_stuck)[None], c[:-1]])
            c[-1] += last * cfg.stay_stuck
            a = np.stack([back * stay + a[1] * (1 - cfg.stay_spike) + a[2] * (1 - cfg.stay_out) + last * (1 - cfg.stay_stuck), back * spikes + a[1] * cfg.stay_spike, back * outs + a[2] * cfg.stay_out])
        a = a * e[i, :3]
        c = c * e[i, 3]
        total = a.sum(0) + c.sum(0)
        a, c = a / total, c / total
        last = c[-1]
        f[i, :3], chain[i] = a, c
    b, d = np.ones((3, lanes)), np.ones((k, lanes))
    for i in range(steps - 1, -1, -1):
        f[i, :3] *= b
        f[i, 3] = (chain[i] * d).sum(0)
        b, d = b * e[i, :3], d * e[i, 3]
        home, end = b[0], d[-1]
        b = np.stack([home * stay + b[1] * spikes + d[0] * cfg.enter_stuck + b[2] * outs, home * (1 - cfg.stay_spike) + b[1] * cfg.stay_spike, home * (1 - cfg.stay_out) + b[2] * cfg.stay_out])
        d = np.concatenate([d[1:], (end * cfg.stay_stuck + home * (1 - cfg.stay_stuck))[None]])
        top = np.maximum(b.max(0), d.max(0))
        b, d = b / top, d / top
    f /= f.sum(1, keepdims=True)
    return f[:, [0, 1, 3, 2]].transpose(2, 0, 1)


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole blocks, with their number in ``blk``, from sorted batches that cut through blocks."""
    rest = None
    for b in chain(batches, [None]):
        t = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
        if t is None or not len(t):
            continue
        key = t[["f", "src", "block"]]
        blk = np.r_[0, np.cumsum((key.to_numpy()[1:] != key.to_numpy()[:-1]).any(1))]
        whole = len(t) if b is None else int(np.searchsorted(blk, blk[-1]))
        rest = None if b is None else t.iloc[whole:]
        if whole:
            yield t.iloc[:whole].assign(blk=blk[:whole])


def _block_distances(t: pd.DataFrame, cfg: SpikeConfig) -> np.ndarray:
    """Distances within each block: blocks are set apart by unusable readings."""
    x = np.where(t["ok"].to_numpy(bool), t["v"].to_numpy(float), np.nan)
    at = np.arange(len(t)) + cfg.side * t["blk"].to_numpy()
    apart = np.full(at[-1] + 1, np.nan)
    apart[at] = x
    return distances(apart[None], cfg.side)[0][at]


_SCATTER = "f string, src string, bin long, n long, same long, mark long"  # mark: 0 distances, 1 least steps, 2 readings out of bounds
_FLAGGED = "f string, src string, ord double, kind string, p_spike double, p_stuck double"
_ZERO = -(2**30)  # the bin of distance 0


def _scatters(batches: Iterator[pd.DataFrame], cfg: SpikeConfig) -> Iterator[pd.DataFrame]:
    """Per source a histogram of the distances of its own readings in log bins, repeats among them, and the bins of its least steps (mark 1)."""
    bin_of = lambda d: np.floor(np.log(d) / np.log(cfg.bin_ratio)).astype(np.int64)
    for t in _whole_blocks(batches):
        r, blk, v = _block_distances(t, cfg), t["blk"].to_numpy(), t["v"].to_numpy(float)
        length, first = run_lengths(v, blk)
        use = t["own"].to_numpy(bool) & ~np.isnan(r) & (length < cfg.stuck_run)
        bins = np.full(len(r), _ZERO, np.int64)
        bins[use & (r > 0)] = bin_of(r[use & (r > 0)])
        seen = pd.DataFrame({"f": t["f"], "src": t["src"], "bin": bins, "n": 1, "same": (~first).astype(np.int64)})[use]
        yield seen.groupby(["f", "src", "bin"], as_index=False).sum().assign(mark=0)
        with np.errstate(invalid="ignore"):
            step = np.abs(np.diff(np.where(t["ok"].to_numpy(bool), v, np.nan)))
        fine = np.isfinite(step) & (step > 0) & (blk[1:] == blk[:-1])
        least = pd.DataFrame({"f": t["f"].iloc[1:][fine], "src": t["src"].iloc[1:][fine], "bin": bin_of(step[fine])})
        yield least.groupby(["f", "src"], as_index=False).min().assign(n=0, same=0, mark=1)
        beyond = t.loc[t["own"].to_numpy(bool) & ~t["ok"].to_numpy(bool), ["f", "src"]].assign(bin=_ZERO, n=1, same=0, mark=2)
        yield beyond.groupby(["f", "src", "bin", "mark"], as_index=False).sum()[["f", "src", "bin", "n", "same", "mark"]]


def _flags(batches: Iterator[pd.DataFrame], cfg: SpikeConfig) -> Iterator[pd.DataFrame]:
    for t in _whole_blocks(batches):
        z = _block_distances(t, cfg) / t["scatter"].to_numpy(float)
        ok, blk, n = t["ok"].to_numpy(bool), t["blk"].to_numpy(), len(t)
        _, first = run_lengths(t["v"].to_numpy(float), blk)
        begin = np.searchsorted(blk, blk)  # where each row's block begins
        inside = np.arange(n) - begin
        start = np.flatnonzero(inside % cfg.chunk == 0)  # each lane decides the chunk that begins here
        i = start[:, None] + np.arange(-cfg.halo, cfg.chunk + cfg.halo)
        at = np.clip(i, 0, n - 1)
        beyond = (i < 0) | (i >= n) | (blk[at] != blk[start][:, None])
        rate = lambda c: t[c].to_numpy(float)[start]
        p = posterior(z[at], ~first[at], ~ok[at], beyond, rate("repeats"), rate("spikes"), rate("outs"), cfg)
        lane = np.searchsorted(start, np.arange(n), side="right") - 1
        p = p[lane, cfg.halo + np.arange(n) - start[lane]]
        kind = np.select([~ok, p[:, 2] > 0.5, p[:, 1] > 0.5], ["out", "stuck", "spike"], "")
        hit = t["own"].to_numpy(bool) & (kind != "")
        yield t.loc[hit, ["f", "src", "ord"]].assign(kind=kind[hit], p_spike=p[hit, 1], p_stuck=p[hit, 2])


def flag_readings(readings: DataFrame, bucket: Column, bounds: dict[str, tuple[float, float]], cfg: SpikeConfig = SpikeConfig()) -> DataFrame:
    """(f, src, ord, kind, p_spike, p_stuck) of each flagged reading; kind is 'out', 'stuck' or 'spike'.

    ``readings``: f (field; key of ``bounds``), src (source), ord (order of
    measurement, double), v. ``bucket`` coarsens ord (see with_positions). Null and
    NaN values, and rows without a finite ord, are no readings. Readings of one source and ord
    are copies, judged once (by the least value, should they differ). A null source
    is the source ''. Sources too short to have neighbours are judged by the bounds
    alone. No rows give no flags.
    """
    one = (
        readings.filter(present(F.col("v")) & finite(F.col("ord")))
        .groupBy("f", F.coalesce("src", F.lit("")).alias("src"), "ord")
        .agg(F.min("v").alias("v"))
    )
    ok = F.lit(False)
    for f, (lo, hi) in bounds.items():
        ok = ok | ((F.col("f") == f) & F.col("v").between(lo, hi) & (F.abs("v") < float("inf")))
    placed = with_positions(one, ["f", "src"], ["ord"], bucket)
    size = cfg.chunk * cfg.block_chunks
    block = F.floor(F.col("pos") / size).cast("bigint")
    inside = F.col("pos") - block * size
    blocks = F.array_compact(
        F.array(block, F.when((inside < cfg.halo) & (block > 0), block - 1), F.when(inside >= size - cfg.halo, block + 1))
    )
    spread = placed.select("f", "src", "ord", "pos", "v", ok.alias("ok"), block.alias("home"), F.explode(blocks).alias("block"))
    spread = spread.select("*", (F.col("home") == F.col("block")).alias("own")).drop("home")
    by_block = lambda df: df.repartition("f", "src", "block").sortWithinPartitions("f", "src", "block", "pos")
    spread = cut(by_block(spread))
    hist = spread.mapInPandas(partial(_scatters, cfg=cfg), _SCATTER)
    hist = hist.groupBy("f", "src", "mark", "bin").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    all_ = Window.partitionBy("f", "src", "mark")
    hist = hist.withColumn("cum", F.sum("n").over(all_.orderBy("bin"))).withColumn("total", F.sum("n").over(all_))
    upper = F.when(F.col("bin") == _ZERO, 0.0).otherwise(F.pow(F.lit(cfg.bin_ratio), F.col("bin") + 1))
    hist = hist.withColumn("upper", upper)
    seen = F.col("mark") == 0
    scale = hist.groupBy("f", "src").agg(
        F.min(F.when(seen & (F.col("cum") >= F.col("total") * cfg.scatter_quantile), F.col("upper"))).alias("q"),
        F.min(F.when(F.col("mark") == 1, F.col("upper"))).alias("step"),
        F.sum("same").alias("same"),
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("mark") == 2, F.col("n")).otherwise(0)).alias("out"),
        F.collect_list(F.when(seen & (F.col("cum") > F.col("total") * 0.9), F.struct("upper", "n"))).alias("far"),  # bins of a histogram, so bounded
    )
    to_90 = float(np.log(10) / -np.log(1 - cfg.scatter_quantile))
    scatter = F.greatest(F.coalesce("q", F.lit(0.0)) * to_90, F.coalesce("step", F.lit(0.0)), F.lit(1e-12))
    all_n = F.greatest(F.col("n"), F.lit(1))
    within = lambda x, lo_hi: F.greatest(F.lit(lo_hi[0]), F.least(F.lit(lo_hi[1]), x))
    scale = scale.withColumn("scatter", scatter).withColumn("far", F.aggregate(F.filter("far", lambda b: b["upper"] > F.col("scatter") * 2 * cfg.spike_from), F.lit(0).cast("bigint"), lambda s, b: s + b["n"]))
    scale = cut(
        scale.select(
            "f", "src", "scatter", (F.col("same") / all_n).alias("repeats"), within(F.col("far") / all_n, cfg.spike_rates).alias("spikes"), within(F.col("out") / (all_n + F.col("out")), cfg.out_rates).alias("outs")
        )
    )
    judged = join_checked(spread, scale, ["f", "src"], "left").fillna({"scatter": 1.0, "repeats": 0.0, "spikes": cfg.spike_rates[0], "outs": cfg.out_rates[0]})
    return by_block(judged).mapInPandas(partial(_flags, cfg=cfg), _FLAGGED)
