"""Fixed-lag smoothing of height and climb on a grid of nodes.

A linear stand-in for a factor graph: state (height, climb), barometer heights and
sparse fixes as measurements. A node is estimated from what was measured up to
``lag`` seconds after it. Influence decays, so a series is cut into blocks of time
that see ``lead`` seconds before and ``lag`` after their own nodes, and blocks are
solved apart (forward filter, backward pass), many at once in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SmootherConfig:
    node_s: float = 0.2
    lag_s: float = 20.0
    lead_s: float = 60.0
    block_s: float = 120.0
    climb_noise: float = 1.5  # m/s per root second
    start_height: float = 100.0
    start_climb: float = 2.0


def solve_blocks(first: np.ndarray, last: np.ndarray, info: np.ndarray, vec: np.ndarray, cfg: SmootherConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height, climb and variance of height (blocks, nodes) of many blocks at once.

    Of each block, ``first`` and ``last`` are the places of its nodes in the arrays, and
    info and vec the weights and weighted heights measured at each; all state is in
    closed form of 2 by 2 matrices (p, q, r: variance of height, covariance, variance of climb).
    """
    blocks, n = info.shape
    dt, noise = cfg.node_s, cfg.climb_noise**2
    q0, q1, q2 = noise * dt**3 / 3, noise * dt**2 / 2, noise * dt
    row = np.arange(blocks)
    h, v = vec[row, first] / info[row, first], np.zeros(blocks)
    p, q, r = np.full(blocks, cfg.start_height**2), np.zeros(blocks), np.full(blocks, cfg.start_climb**2)
    before, after = np.empty((5, blocks, n)), np.empty((5, blocks, n))
    for i in range(n):
        go = i > first
        h, p = np.where(go, h + dt * v, h), np.where(go, p + 2 * dt * q + dt * dt * r + q0, p)
        q, r = np.where(go, q + dt * r + q1, q), np.where(go, r + q2, r)
        before[:, :, i] = h, v, p, q, r
        seen = (info[:, i] > 0) & (i >= first)
        w = np.where(seen, info[:, i], 1.0)
        k0, k1 = np.where(seen, p / (p + 1 / w), 0.0), np.where(seen, q / (p + 1 / w), 0.0)
        gap = np.where(seen, vec[:, i] / w - h, 0.0)
        h, v = h + k0 * gap, v + k1 * gap
        p, q, r = p - k0 * p, q - k0 * q, r - k1 * q
        after[:, :, i] = h, v, p, q, r
    out = after.copy()
    for i in range(n - 2, -1, -1):
        h, v, p, q, r = after[:, :, i]
        fh, fv, fp, fq, fr = before[:, :, i + 1]
        det = fp * fr - fq * fq
        # gain: after times the transposed step times the inverse of what was predicted
        c0, c1, c2, c3 = p + dt * q, q, q + dt * r, r
        g00, g01, g10, g11 = (c0 * fr - c1 * fq) / det, (c1 * fp - c0 * fq) / det, (c2 * fr - c3 * fq) / det, (c3 * fp - c2 * fq) / det
        nh, nv, np_, nq, nr = out[:, :, i + 1]
        dh, dv, dp, dq, dr = nh - fh, nv - fv, np_ - fp, nq - fq, nr - fr
        back = (
            h + g00 * dh + g01 * dv,
            v + g10 * dh + g11 * dv,
            p + g00 * g00 * dp + 2 * g00 * g01 * dq + g01 * g01 * dr,
            q + g00 * g10 * dp + (g00 * g11 + g01 * g10) * dq + g01 * g11 * dr,
            r + g10 * g10 * dp + 2 * g10 * g11 * dq + g11 * g11 * dr,
        )
        out[:, :, i] = np.where((i >= first) & (i < last), back, out[:, :, i])
    return out[0], out[1], out[2]


_KEYS = ["flight_id", "seg", "block"]


def _solve(batches: Iterator[pd.DataFrame], cfg: SmootherConfig) -> Iterator[pd.DataFrame]:
    """Rows sorted by block: whole blocks are solved together, as many as a batch holds."""
    rest = None
    for t in chain(batches, [None]):
        d = rest if t is None else t if rest is None else pd.concat([rest, t], ignore_index=True)
        if d is None or not len(d):
            continue
        key = d[_KEYS].to_numpy()
        blk = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(1))]
        whole = len(d) if t is None else int(np.searchsorted(blk, blk[-1]))
        rest = None if t is None else d.iloc[whole:]
        if not whole:
            continue
        d, blk = d.iloc[:whole], blk[:whole]
        lead = np.searchsorted(blk, np.arange(blk[-1] + 1))
        node = d["node"].to_numpy(np.int64)
        lo, hi = np.minimum.reduceat(node, lead), np.maximum.reduceat(node, lead)
        info, vec = np.zeros((len(lead), int((hi - lo).max()) + 1)), np.zeros((len(lead), int((hi - lo).max()) + 1))
        w = 1 / d["sigma"].to_numpy() ** 2
        np.add.at(info, (blk, node - lo[blk]), w)  # measurements of a node add up
        np.add.at(vec, (blk, node - lo[blk]), w * d["z"].to_numpy())
        u, vu, var = solve_blocks(np.zeros(len(lead), int), hi - lo, info, vec, cfg)
        nodes = lo[:, None] + np.arange(info.shape[1])
        block = d["block"].to_numpy()[lead]
        own = (nodes <= hi[:, None]) & (np.floor(nodes * cfg.node_s / cfg.block_s + 1e-9) == block[:, None])
        which = np.nonzero(own)[0]
        head = d.iloc[lead].iloc[which]
        yield pd.DataFrame({"flight_id": head["flight_id"].to_numpy(), "seg": head["seg"].to_numpy(), "node": nodes[own], "u": u[own], "vu": vu[own], "sigma_u": np.sqrt(var[own])})


def smooth_heights(measured: DataFrame, cfg: SmootherConfig = SmootherConfig()) -> DataFrame:
    """measured: flight_id, seg, tr, z, sigma, kind. One row per node between the measurements of a block and its surroundings."""
    at = lambda s: F.floor((F.col("tr") + s) / cfg.block_s)
    blocks = F.array_distinct(F.array(at(0), at(-cfg.lag_s), at(cfg.lead_s)))  # own, those it comes after, those it leads into
    d = measured.select("flight_id", "seg", F.floor(F.col("tr") / cfg.node_s + 0.5).alias("node"), "z", "sigma", "kind", F.explode(blocks).alias("block"))
    d = d.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "node", "kind", "z")
    return d.mapInPandas(partial(_solve, cfg=cfg), "flight_id long, seg long, node long, u double, vu double, sigma_u double")
