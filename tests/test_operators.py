"""Time joins, frames and filters against pandas and NumPy; what comes later must not change what came before."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.operators import recurrence as R
from tracklane.operators.align import asof, interpolate
from tracklane.operators.frames import block_window, exact_percentiles, in_blocks, owned, running_sum, with_rolling_mad
from tracklane.operators.joins import join_checked
from tracklane.operators.positions import with_positions
from tracklane.operators.robust import robust_sigma, robust_vector_mean
from tracklane.operators.smoother import SmootherConfig, smooth_heights

K = ["f"]


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(1)
    a = [(f, i, rng.choice(range(400)) / 4) for f in (1, 2) for i in range(80)]
    b = sorted({(f, rng.choice(range(400)) / 4) for f in (1, 2) for _ in range(60)})
    b = [(f, t, rng.gauss(0, 5)) for f, t in b]
    return spark.createDataFrame(a, "f int, i int, t double"), spark.createDataFrame(b, "f int, t double, v double")


@pytest.mark.parametrize("shard", [1.0, 7.0, 600.0])
def test_asof_and_interpolation_whatever_the_shards(two, shard):
    left, right = two
    ref = right.toPandas()
    got = asof(left, right, K, "t", ["v"], tolerance=2.0, shard=shard).toPandas()
    line = {(r.f, r.i): r for r in interpolate(left, right, K, "t", ["v"], shard=shard).toPandas().itertuples()}
    ends = {(r.f, r.i): r for r in interpolate(left, right, K, "t", ["v"], clamp=True, shard=shard).toPandas().itertuples()}
    assert len(got) == left.count()
    for r in got.itertuples():
        own = ref[ref.f == r.f].sort_values("t")
        before = own[own.t <= r.t]
        if len(before) and r.t - before.t.iloc[-1] <= 2:
            assert (r.v, r.age) == (before.v.iloc[-1], r.t - before.t.iloc[-1])
        else:
            assert math.isnan(r.v) and math.isnan(r.age)
        want = np.interp(r.t, own.t, own.v)
        assert math.isclose(ends[r.f, r.i].v_at, want, abs_tol=1e-9)
        if own.t.min() <= r.t <= own.t.max():
            assert math.isclose(line[r.f, r.i].v_at, want, abs_tol=1e-9)
        else:
            assert math.isnan(line[r.f, r.i].v_at)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    data = [(f, float(t), None if rng.random() < 0.1 else rng.gauss(0, 1)) for f in (1, 2) for t in sorted(rng.sample(range(2000), 150))]
    return spark.createDataFrame(data, "f int, t double, v double"), pd.DataFrame(data, columns=["f", "t", "v"])


def test_frames_over_block_borders(series):
    df, ref = series
    d = in_blocks(df, K, ["t"], F.floor(F.col("t") / 100), 10, 2, block=16)
    w = block_window(K).rowsBetween(-6, 0)
    d = with_rolling_mad(d.withColumn("m", F.percentile("v", 0.5).over(w)).withColumn("nx", F.lead("v", 2).over(block_window(K))), "v", w, "mad")
    got = owned(d).toPandas().sort_values(["f", "t"])
    assert len(got) == len(ref)
    for f, g in ref.groupby("f"):
        mine = got[got.f == f]
        np.testing.assert_allclose(mine.m, g.v.rolling(7, min_periods=1).median(), rtol=1e-12)
        mad = g.v.rolling(7, min_periods=1).apply(lambda x: np.nanmedian(np.abs(x - np.nanmedian(x))))
        np.testing.assert_allclose(mine.mad, mad, rtol=1e-9)
        np.testing.assert_allclose(mine.nx, g.v.shift(-2))
        assert mine.pos.tolist() == list(range(len(g)))


def test_running_sum_and_exact_percentiles(series):
    df, ref = series
    placed = with_positions(df, K, ["t"], F.floor(F.col("t") / 50))
    got = running_sum(placed, K, {"s": F.col("v")}, block=16).toPandas().sort_values(["f", "t"])
    for f, g in ref.groupby("f"):
        np.testing.assert_allclose(got[got.f == f].s, g.v.fillna(0).cumsum(), atol=1e-9)
    p = {r["f"]: r for r in exact_percentiles(df, K, "v", {"a": 0.05, "b": 0.5, "c": 1.0}).collect()}
    for f, g in ref.groupby("f"):
        np.testing.assert_allclose([p[f]["a"], p[f]["b"], p[f]["c"]], g.v.dropna().quantile([0.05, 0.5, 1.0]))


def test_percentiles_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)] * 5 + [(None, 3.0)] + [(1, None), (2, -0.0), (2, 0.0)], "f int, v double")
    got = {r["f"]: (r["n"], r["m"]) for r in exact_percentiles(df, K, "v", {"m": 0.5}).collect()}
    assert got == {None: (6, 1.0), 2: (2, 0.0)}
    assert exact_percentiles(df.filter("false"), K, "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("seed", [None, 0.0])
def test_low_pass_in_blocks_is_the_plain_recursion(series, seed):
    df, ref = series
    got = R.low_pass(df, K, "t", [], "v", R.exponential_gain(30.0), block=16, seed=seed).toPandas().sort_values(["f", "t"])
    for f, g in ref.groupby("f"):
        y, out, last = seed, [], None
        for t, x in zip(g.t, g.v, strict=True):
            if not math.isnan(x):
                if y is None:
                    y = x
                elif last is not None:
                    y += (1 - math.exp(-(t - last) / 30)) * (x - y)
            out.append(math.nan if y is None else y)
            last = t
        np.testing.assert_allclose(got[got.f == f].y.astype(float), out, atol=1e-9)


def test_low_pass_does_not_fill_before_the_first_value(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, 1.0, None), (1, 2.0, 10.0), (1, 3.0, 20.0)], "f int, t double, v double")
    y = [r["y"] for r in R.low_pass(df, K, "t", [], "v", R.exponential_gain(1.0)).orderBy("t").collect()]
    assert y[:3] == [None, None, 10.0] and 10 < y[3] < 20


def run(kernel, rows):
    step = kernel()
    return [step(r) for r in rows]


class Row:
    def __init__(self, **kw):
        self.__dict__.update(kw)


def test_bias_gates_and_causality():
    ev = lambda t, s, u: Row(tr=t, source=s, u=u)
    out = run(R.bias_ewma, [ev(0, 5.0, 2.0), ev(10, 5.0, 100.0)])
    assert [o[2] for o in out] == [True, False] and out[1][3] == out[0][3] > 0
    assert run(R.bias_ewma, [ev(0, 5.0, 2.0)]) == out[:1]  # what comes later changes nothing


def test_kalman_rejects_and_stays_bounded():
    rows = [Row(tr=t, source=8.0, u=u, speed=10.0) for t, u in ((10, 5.0), (20, 5.0), (30, 100.0))]
    out = run(R.bias_kalman, rows)
    assert [o[2] for o in out] == [True, True, False]
    assert run(R.bias_kalman, rows[:2]) == out[:2]
    first = run(R.bias_kalman, [Row(tr=5, source=8.0, u=5.0, speed=None)] + rows)
    assert first[0][2] is False and first[1:] == out  # without a speed a fix leaves no trace


def test_reverting_filter_forgets():
    kernel = lambda state=None: R.bias_kalman(revert=(20.0, 40.0), state=state)
    rows = [Row(tr=0, source=None, u=8.0, speed=0.0), Row(tr=10, source=8.0, u=5.0, speed=0.0)] + [Row(tr=t, source=None, u=8.0, speed=0.0) for t in range(10, 101)]
    out = run(kernel, rows)
    assert abs(out[-1][3]) < 0.02 * abs(out[1][3]) and out[1][3] > 0


def test_confidence_rises_and_falls_and_is_causal():
    kernel = lambda state=None: R.confidence(least=2, keep=3, most=3.0, spread=2.0, rise=2.0, state=state)
    ev = lambda t, ok=True: Row(tr=t, is_event=True, accepted=ok, inn=0.5, bias=1.0)
    at = lambda t: Row(tr=t, is_event=False, accepted=False, inn=None, bias=None)
    rows = [at(0), ev(1), at(1), ev(2), at(2), at(3), at(4), ev(5, False), at(5), at(6)]
    c = [o[0] for o in run(kernel, rows)]
    assert c[0] == c[2] == 0 and c[6] > c[5] > 0 and c[9] < c[8]
    assert c == [o[0] for o in run(kernel, rows + [ev(20)])][: len(c)]


def test_hold_then_decay():
    rows = [Row(t=t / 10, x=5.0, bad=t > 0) for t in range(20)]
    y = [o[0] for o in run(R.hold_decay, rows)]
    assert y[:6] == [5.0] * 6 and math.isclose(y[15], 5 * math.exp(-1.0 / 0.5), rel_tol=1e-9)


def test_robust_statistics(spark):
    rng = random.Random(3)
    v = [rng.gauss(0, 1) for _ in range(50)] + [1000.0]
    df = spark.createDataFrame([(1, x, 0.0, 0.0) for x in v] + [(2, 1.0, 2.0, 3.0)] * 3, "f int, x double, y double, z double")
    r = {r["f"]: r for r in robust_sigma(df, K, "x").collect()}
    mad = np.median(np.abs(v - np.median(v)))
    assert math.isclose(r[1]["sigma"], 1.4826 * mad) and r[2]["sigma"] is None
    m = {r["f"]: r for r in robust_vector_mean(df, K, ["x", "y", "z"]).collect()}
    assert abs(m[1]["x"]) < 1 and m[1]["kept"] < 51 and (m[2]["kept"], m[2]["z"]) == (3, 3.0)


def test_checked_join_is_the_same_beyond_the_limit(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("f"), "id").unionByName(spark.range(3).select(F.lit(None).cast("bigint").alias("f"), "id"))
    small = spark.createDataFrame([(i, i * 10) for i in range(5)] + [(None, 99)], "f bigint, w int")
    got = [sorted(map(tuple, join_checked(big, small, K, "left", n).collect()), key=str) for n in (100, 2)]
    assert got[0] == got[1] and len(got[0]) == 1003


def test_geodesy_there_and_back(spark):
    df = spark.createDataFrame([(55.1, 64.5, 477.0), (-33.0, -70.0, 10.0)], "lat double, lon double, alt double")
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    for r in geo.geodetic(df.select("*", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z").collect():
        assert abs(r["lat"] - r["lat_at"]) < 1e-9 and abs(r["lon"] - r["lon_at"]) < 1e-9 and abs(r["alt"] - r["alt_at"]) < 1e-6
    e, n, u = geo.body_to_enu(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, math.pi / 2)))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), u.alias("u")).first()
    assert math.isclose(r["e"], 1.0) and abs(r["n"]) < 1e-12 and abs(r["u"]) < 1e-12


def test_smoother_follows_and_its_blocks_agree(spark):
    rng = random.Random(4)
    data = [(1, 0, t / 2, 100 + t / 4 + rng.gauss(0, 1.5), 1.5, 0) for t in range(600)]
    df = spark.createDataFrame(data, "flight_id bigint, seg bigint, tr double, z double, sigma double, kind int")
    one = smooth_heights(df, SmootherConfig(block_s=10_000.0)).toPandas().set_index("node")
    cut = smooth_heights(df, SmootherConfig(block_s=60.0)).toPandas().set_index("node")
    assert sorted(one.index) == sorted(cut.index) and len(one) == 1499
    mid = one.index[(one.index > 100) & (one.index < 1300)]
    assert (abs(one.u - (100 + one.index * 0.1)).loc[mid] < 4).all()
    assert (abs(one.u - cut.u).loc[mid] < 1e-3).all()


def test_steps_composed_by_doubling_are_those_one_by_one():
    rng = np.random.default_rng(5)
    f, g, first = rng.uniform(0, 1, 300), rng.normal(size=300), rng.uniform(size=300) < 0.05
    f[rng.uniform(size=300) < 0.1] = 0.0
    first[0] = True
    a, b = R.compose_steps(f, g, first)
    x = y = None
    for i in range(300):
        x, y = (f[i], g[i]) if first[i] else (f[i] * x, f[i] * y + g[i])
        assert abs(a[i] - x) < 1e-12 and abs(b[i] - y) < 1e-12
