"""Filters and estimators that carry a state along a series.

Linear low-pass filters are computed block by block and joined by a scan over the
blocks (a block's output is linear in what comes in), so they run in parallel within
a series. Estimators with gates are sequential by nature: they see only the sparse
events of a series, streamed in order through a task that holds one state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.operators.frames import BLOCK
from tracklane.operators.positions import with_positions


def compose_steps(f: np.ndarray, g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of steps y -> f y + g in a row, the factor and offset of all up to each since the last ``first``: by doubling, so in few passes over the arrays."""
    a, b, n, reach = f.astype(float), g.astype(float), len(f), 1
    since = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))  # steps before each in its stretch
    while reach < n:
        i = np.flatnonzero(since >= reach)
        if not len(i):
            break
        b[i] += a[i] * b[i - reach]  # the right side is evaluated before it is written
        a[i] *= a[i - reach]
        reach *= 2
    return a, b


def _compose(batches: Iterator[pd.DataFrame], keys: list[str], out: list[str]) -> Iterator[pd.DataFrame]:
    """Per row the factor (a) and offset (b) of all steps of its block so far: y = b + a * carry."""
    key, x, y = None, 1.0, 0.0
    for t in batches:
        if not len(t):
            continue
        head = t[[*keys, "_block"]]
        first = np.r_[True, (head.iloc[1:].to_numpy() != head.iloc[:-1].to_numpy()).any(1)]
        a, b = compose_steps(t["_f"].to_numpy(), t["_g"].to_numpy(), first)
        if key == tuple(head.iloc[0]):  # the block goes on from the batch before
            same = np.cumsum(first) == 1
            b[same] += a[same] * y
            a[same] *= x
        key, x, y = tuple(head.iloc[-1]), a[-1], b[-1]
        yield t[out].assign(_a=a, _b=b)


def low_pass(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, gain: Callable[[Column], Column], name: str = "y", block: int = BLOCK, seed: float | None = None) -> DataFrame:
    """First-order low-pass by time: y += gain(dt) * (x - y), hold where x is missing.

    dt counts from the previous row, missing or not. Without ``seed`` the first value
    seeds the filter and rows before it have null; with it, y starts from ``seed`` at
    the first row. ``order`` breaks ties after ``time``.
    """
    d = with_positions(df, keys, [time, *order], F.floor(F.col(time) / 600))
    d = d.withColumn("_block", F.floor(F.col("pos") / block))
    edge = d.groupBy(*keys, "_block").agg(F.max(time).alias("_end"), F.max(F.col(value).isNotNull()).alias("_some"))
    scan = Window.partitionBy(*keys).orderBy("_block")
    ks = [f"_e{i}" for i in range(len(keys))]
    edge = edge.select(
        *(F.col(k).alias(e) for k, e in zip(keys, ks, strict=True)),
        F.col("_block").alias("_eb"),
        F.lag("_end").over(scan).alias("_before"),
        F.coalesce(F.max("_some").over(scan.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("_seeded"),
    )
    on = lambda: [F.col(k).eqNullSafe(F.col(e)) for k, e in zip(keys, ks, strict=True)] + [F.col("_block") == F.col("_eb")]
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    d = d.join(edge, on()).drop(*ks, "_eb")
    before = F.coalesce(F.lag(time).over(w), F.col("_before"))
    had = F.col("_seeded") | F.coalesce(F.max(F.col(value).isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    dt = F.col(time) - before
    step = F.coalesce(gain(dt), F.lit(1.0 if seed is None else 0.0))
    first = ~had & F.col(value).isNotNull() if seed is None else F.lit(False)
    g = F.when(F.col(value).isNull(), 0.0).when(first, 1.0).otherwise(step)
    d = d.withColumn("_had", had | F.col(value).isNotNull() if seed is None else F.lit(True))
    d = d.withColumns({"_f": 1 - g, "_g": F.when(F.col(value).isNull(), 0.0).otherwise(g * F.col(value))})
    out = [*df.columns, "pos", "_block", "_had"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*out).schema) + ", _a double, _b double"
    sorted_ = d.select(*out, "_f", "_g").repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "pos")
    parts = sorted_.mapInPandas(partial(_compose, keys=keys, out=out), schema)
    # one row per block: its whole factor and offset, composed along the series
    ends = parts.groupBy(*keys, "_block").agg(F.max_by("_a", "pos").alias("a"), F.max_by("_b", "pos").alias("b"))
    ends = sequential(ends, keys, ["_block"], partial(_carried, 0.0 if seed is None else float(seed)), "_carry double")
    ends = ends.select(*(F.col(k).alias(e) for k, e in zip(keys, ks, strict=True)), F.col("_block").alias("_eb"), "_carry")
    return parts.join(ends, on()).select(*df.columns, F.when(F.col("_had"), F.col("_b") + F.col("_a") * F.col("_carry")).alias(name))


def _carried(seed: float) -> Callable[[tuple], tuple]:
    """Rows (.a, .b) of blocks in order: what comes into each block."""
    s = {"y": seed}

    def step(r) -> tuple:
        into = s["y"]
        s["y"] = r.b + r.a * into
        return (into,)

    return step


def exponential_gain(tau: float) -> Callable[[Column], Column]:
    return lambda dt: 1 - F.exp(-dt / tau)


def rational_gain(tau: float, least_dt: float = 1e-4) -> Callable[[Column], Column]:
    return lambda dt: F.when(dt.isNotNull(), F.greatest(F.lit(least_dt), dt) / (tau + F.greatest(F.lit(least_dt), dt)))


# Makes the step function of a series; steps keep their state in a dict that is also their attribute ``state``.
Kernel = Callable[..., Callable[[tuple], tuple]]


def _stream(batches: Iterator[pd.DataFrame], keys: list[str], kernel: Kernel, names: list[str], out: list[str]) -> Iterator[pd.DataFrame]:
    key, step = None, None
    for t in batches:
        if not len(t):
            continue
        rows, head = [], list(zip(*(t[k] for k in keys), strict=True))
        for k, r in zip(head, t.itertuples(index=False), strict=True):
            if k != key or step is None:
                key, step = k, kernel()
            rows.append(step(r))
        yield pd.concat([t.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)[out]


def sequential(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, results: str) -> DataFrame:
    """Run ``kernel`` over each series in order: kernel() makes a step function, rows in and tuples of ``results`` out.

    Rows stream through in batches; a task holds one state, never a series.
    """
    names = [x.split()[0] for x in results.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + results
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(partial(_stream, keys=keys, kernel=kernel, names=names, out=[*df.columns, *names]), schema)


def _gone(x: float | None) -> bool:
    return x is None or x != x


def hold_decay(hold: float = 0.5, tau: float = 0.5, least: float = 0.0, state: dict | None = None) -> Callable[[tuple], tuple]:
    """Rows (.t, .x, .bad): the last good value is held for ``hold`` seconds, then decays."""
    s = state or {"good": 0.0, "held": 0.0, "t": None}

    def step(r) -> tuple:
        dt = 0.0 if s["t"] is None else max(r.t - s["t"], least)
        s["t"] = r.t
        if not r.bad and not _gone(r.x):
            s["good"], s["held"] = r.x, 0.0
            return (r.x,)
        s["held"] += dt
        return (s["good"] if s["held"] <= hold else s["good"] * math.exp(-(s["held"] - hold) / tau),)

    step.state = s
    return step


def bias_ewma(gate: float = 6.0, clip: float = 3.0, tau: float = 30.0, first_dt: float = 10.0, state: dict | None = None) -> Callable[[tuple], tuple]:
    """Rows (.tr, .source, .u): running bias of source against u, with an innovation gate and a clipped update."""
    s = state or {"b": 0.0, "t": None}

    def step(r) -> tuple:
        m = r.source - r.u
        inn = m - s["b"]
        ok = abs(inn) <= gate
        g = 1 - math.exp(-(first_dt if s["t"] is None else r.tr - s["t"]) / tau)
        s["t"] = r.tr
        if ok:
            s["b"] += g * min(max(inn, -clip), clip)
        return m, inn, ok, s["b"]

    step.state = s
    return step


def bias_kalman(gate=10.0, clip=3.0, noise=1.5, walk=(0.1, 0.02), start=4.0, first_dt=10.0, low=(-8.0, 0.0), high=(8.0, 12.0), revert: tuple[float, float] | None = None, state: dict | None = None) -> Callable[[tuple], tuple]:
    """Rows (.tr, .source, .u, .speed): bias and gain on (speed / 10)**2; with ``revert`` (time constants) both decay to 0.

    With ``revert``, rows without a source are samples that only ask for the state. A row without speed is skipped: it leaves the state as it was (with ``revert``,
    as predicted to its time).
    """
    s = state or {"x": np.zeros(2), "p": np.diag([start**2, start**2]), "t": None}

    def predict(t: float) -> None:
        dt = (0.0 if revert else first_dt) if s["t"] is None else max(0.0, t - s["t"])
        d = np.exp(-dt / np.asarray(revert)) if revert else np.ones(2)
        s["x"] = d * s["x"]
        s["p"] = s["p"] * np.outer(d, d) + np.diag(np.square(walk)) * dt
        s["t"] = t

    def step(r) -> tuple:
        none = _gone(r.speed) or _gone(r.source)
        if revert or not none:
            predict(r.tr)
        if none:
            return None, None, False, *map(float, s["x"])
        h = np.array([1.0, (r.speed / 10) ** 2])
        m = r.source - r.u
        inn = m - h @ s["x"]
        ok = bool(abs(inn) <= gate)
        if ok:
            k = s["p"] @ h / (h @ s["p"] @ h + noise**2)
            s["x"] = np.clip(s["x"] + k * min(max(inn, -clip), clip), low, high)
            p = (np.eye(2) - np.outer(k, h)) @ s["p"]
            s["p"] = (p + p.T) / 2
        return float(m), float(inn), ok, *map(float, s["x"])

    step.state = s
    return step


def confidence(least: int, keep: int, most: float, spread: float, rise: float, fall: float = 3.0, age: float = 20.0, state: dict | None = None) -> Callable[[tuple], tuple]:
    """Rows (.tr, .is_event, .accepted, .inn, .bias), events before samples at a time: trust in a correction, 0 to 1."""
    s = state or {"c": 0.0, "target": 0.0, "t": None, "trusted": None, "seen": []}

    def approach(t: float) -> None:
        dt = 0.0 if s["t"] is None else t - s["t"]
        tau = rise if s["target"] > s["c"] else fall
        s["c"] += (1 - math.exp(-dt / tau)) * (s["target"] - s["c"])
        s["t"] = t

    def step(r) -> tuple:
        if r.is_event:
            approach(r.tr)
            if r.accepted and not _gone(r.inn) and abs(r.inn) <= most:
                s["seen"] = [*s["seen"], r.bias][-keep:]
                mid = float(np.median(s["seen"]))
                stable = len(s["seen"]) >= least and float(np.median(np.abs(np.array(s["seen"]) - mid))) <= spread
                s["target"] = 1.0 if stable else 0.0
                if stable:
                    s["trusted"] = r.tr
            else:
                s["seen"], s["target"] = [], 0.0
        else:
            if s["trusted"] is None or r.tr - s["trusted"] > age:
                s["target"] = 0.0
            approach(r.tr)
        return (min(max(s["c"], 0.0), 1.0),)

    step.state = s
    return step


def kalman_over_gaps(revert: tuple[float, float], gate=10.0, clip=3.0, noise=1.5, start=4.0, low=(-8.0, 0.0), high=(8.0, 12.0)) -> Callable[[tuple], tuple]:
    """``bias_kalman`` with ``revert`` over its events alone: rows (.source, .u, .speed, .since, .grown0, .grown1) that say how long ago the last event (or the series' beginning) was and by how much the variances have grown since, sample by sample."""
    s = {"x": np.zeros(2), "p": np.diag([start**2, start**2])}

    def step(r) -> tuple:
        d = np.exp(-r.since / np.asarray(revert))
        x, p = d * s["x"], s["p"] * np.outer(d, d) + np.diag([r.grown0, r.grown1])
        h = np.array([1.0, (r.speed / 10) ** 2])
        m = r.source - r.u
        inn = m - h @ x
        ok = bool(abs(inn) <= gate)
        if ok:
            k = p @ h / (h @ p @ h + noise**2)
            x = np.clip(x + k * min(max(inn, -clip), clip), low, high)
            p = (np.eye(2) - np.outer(k, h)) @ p
            p = (p + p.T) / 2
        s["x"], s["p"] = x, p
        return float(m), float(inn), ok, float(x[0]), float(x[1])

    return step


def confidence_over_gaps(least: int, keep: int, most: float, spread: float, rise: float, fall: float = 3.0, age: float = 20.0) -> Callable[[tuple], tuple]:
    """``confidence`` over its events alone: rows (.tr, .accepted, .inn, .m, .last, .last_fresh) with the last sample before the next event and the last of those no older than ``age``; trust and whether it rises after each event.

    Only an event that is stable lets trust rise, from that event on; so where it falls
    again, for want of events, follows from the samples after it.
    """
    s = {"c": 0.0, "up": False, "r": None, "seen": []}

    def step(r) -> tuple:
        e = s["r"]
        if e is not None:
            turn = e.tr  # from when on trust falls
            if s["up"]:
                turn = r.tr if _gone(e.last) or e.last - e.tr <= age else e.tr if _gone(e.last_fresh) else e.last_fresh
                s["c"] = 1 + (s["c"] - 1) * math.exp(-(turn - e.tr) / rise)
            s["c"] *= math.exp(-(r.tr - turn) / fall)
        s["up"], s["r"] = False, r
        if r.accepted and abs(r.inn) <= most:
            s["seen"] = [*s["seen"], r.m][-keep:]
            mid = float(np.median(s["seen"]))
            s["up"] = len(s["seen"]) >= least and float(np.median(np.abs(np.array(s["seen"]) - mid))) <= spread
        else:
            s["seen"] = []
        return s["c"], s["up"]

    return step


def exponential(tau: float, state: dict | None = None) -> Callable[[tuple], tuple]:
    """Rows (.t, .x): the low-pass with gain 1 - exp(-dt / tau), as in ``low_pass`` without a seed."""
    s = state or {"y": None, "t": None}

    def step(r) -> tuple:
        dt = 0.0 if s["t"] is None else r.t - s["t"]
        s["t"] = r.t
        if not _gone(r.x):
            s["y"] = r.x if s["y"] is None else s["y"] + (1 - math.exp(-dt / tau)) * (r.x - s["y"])
        return (s["y"],)

    step.state = s
    return step
