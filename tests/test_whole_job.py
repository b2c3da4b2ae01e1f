"""Queries over attitudes of every unit, delays by small steps and whole time ranges."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tracklane.operators.delays import at_delays
from tracklane.operators.frames import exact_percentiles

EULER = "sample_id bigint, flight_id bigint, origin string, tr double, roll double, pitch double, yaw double, angle_unit string, raw_text string"
VISION = "sample_id bigint, flight_id bigint, seg bigint, t double, tr double, tr_arrival double, vx double, vy double, vz double"
GPS = "fix_id bigint, flight_id bigint, seg bigint, t double, tr double, status int, lat double, lon double, alt double, e double, n double, u double"


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return entry.queries()[name](spark, str(folder)).collect()


def told(flight, unit, per, stated, times, yaw, note=None):
    """An attitude a row, ``per`` radians to its unit."""
    rows = [(1000 * flight + i, flight, unit, float(t), 0.1 / per, 0.05 / per, yaw(t) / per, stated, None) for i, t in enumerate(times)]
    return rows + ([(1000 * flight + 999, flight, unit, None, None, None, None, None, note)] if note else [])


UNITS = [(1, "rad", 1.0, "rad", None), (2, "rad", 1.0, "Radians", None), (3, "deg", math.pi / 180, "°", None), (4, "mrad", 0.001, "millirad", None), (5, "grad", math.pi / 200, None, "units: gon")]


def test_velocity_turned_by_attitudes_of_every_unit(spark, tmp_path):
    euler = [r for f, o, per, stated, note in UNITS for r in told(f, o, per, stated, range(4), lambda t: 0.3 * t, note)]
    vision = [(100 * f + i, f, 0, 0.0, i + 0.25, 0.0, 3.0, 1.0, -0.5) for f, *_ in UNITS for i in range(4)]
    write(spark, tmp_path, euler_raw=(euler, EULER), vision_velocity_corrected_frd=(vision, VISION))
    rows = run(spark, tmp_path, "q_body_to_enu")
    by = {(r["flight_id"], r["sample_id"] % 100): (r["ve"], r["vn"], r["vu"]) for r in rows}
    assert len(by) == len(rows) == 20 and all(math.dist(v, by[1, i]) < 1e-4 for (_, i), v in by.items())
    assert {r["age"] for r in rows} == {0.25} and not any(r["unsure"] for r in rows)


def circle(flight, radius=200.0, rate=0.05, n=120):
    """Fixes of a turn, and the yaw along it."""
    at = lambda t: rate * t
    return [(1000 * flight + i, flight, 0, 0.0, float(i), 1, 50.0, 8.0, 100.0, radius * -math.cos(at(i)), radius * math.sin(at(i)), 100.0) for i in range(n)]


def test_course_delay_of_every_unit(spark, tmp_path):
    # a fix at tr shows the course of tr - 0.5
    euler = [r for f, o, per, stated, note in UNITS for r in told(f, o, per, stated, [k / 5 for k in range(-20, 620)], lambda t: 0.05 * (t + 0.5) + 1.0, note)]
    write(spark, tmp_path, euler_raw=(euler, EULER), gps_ref_enu=([r for f, *_ in UNITS for r in circle(f)], GPS))
    rows = run(spark, tmp_path, "q_course_delay")
    assert sorted(r["flight_id"] for r in rows) == [1, 2, 3, 4, 5]


ALIGNED = "flight_id bigint, tr double, series string, matching_mode string, err_u double"
SERIES = {"prepared_baro_u": 2.0, "fused_raw_u": 1.0, "fused_exported_u": 1.5}


def test_comparisons_take_all_times_and_errors(spark, tmp_path):
    rows = [(1, float(t), s, "causal_backward", e) for t in range(0, 1081, 10) for s, e in SERIES.items()]
    rows[-1] = (*rows[-1][:4], 2000.0)  # the exported series, at 1080 s
    write(spark, tmp_path, fusion_height_aligned_samples=(rows, ALIGNED))
    got = {r["series"]: r for r in run(spark, tmp_path, "q_variant_compare")}
    assert [got[s]["n"] for s in SERIES] == [109] * 3 and got["fused_exported_u"]["most"] == 2000.0 and got["fused_raw_u"]["rmse"] == 1.0
    (g,) = run(spark, tmp_path, "q_guardrails")
    assert (g["times"], g["shared"], g["only_exported"], g["most"]) == (109, 109, 0, 1999.0)


def test_decisions_over_the_windows_of_the_survey(spark, tmp_path):
    # the candidate is worse in the last window only, after 900 s
    err = lambda s, t: 2.1 if s == "fused_raw_u" and t >= 900 else SERIES[s]
    rows = [(1, t + 0.5, s, "causal_backward", err(s, t)) for t in range(0, 1080, 10) for s in SERIES]
    write(spark, tmp_path, fusion_height_aligned_samples=(rows, ALIGNED))
    by = {r["role"]: r for r in run(spark, tmp_path, "q_window_decision")}
    p, s = by["primary"], by["startup_stress"]
    assert (p["windows"], p["wins"], p["mid"], p["unequal_windows"], p["accepted"]) == (6, 5, 50.0, 0, True) and -10 < p["worst"] < 0
    assert (s["windows"], s["wins"], s["accepted"]) == (4, 3, None)
    held = {r["held"]: r for r in run(spark, tmp_path, "q_lobo_select")}
    assert sorted(held) == [f"long_o{o:03d}_d180" for o in range(0, 901, 180)] and held["long_o900_d180"]["policy"] == "fused_raw_u/causal_backward"
    (t,) = run(spark, tmp_path, "q_sign_permutation")
    assert t["windows"] == 6 and t["mean_gain"] > 0 and t["p_value"] == 2 / 64
    # a sample less of the candidate in a stress window
    write(spark, tmp_path, fusion_height_aligned_samples=([r for r in rows if r[1] != 40.5 or r[2] != "fused_raw_u"], ALIGNED))
    r = next(r for r in run(spark, tmp_path, "q_window_decision") if r["role"] == "primary")
    assert r["unequal_windows"] == 2 and r["accepted"] is False


def path(times, lag=0.0, step=0.01):
    """Where one is at times - lag, at 10 m/s on a course of 2 sin(0.3 t)."""
    e, n, at = 0.0, 0.0, {}
    for k in range(-500, 6500):
        at[k] = (e, n)
        e, n = e + 10 * step * math.sin(2 * math.sin(0.3 * (k + 0.5) * step)), n + 10 * step * math.cos(2 * math.sin(0.3 * (k + 0.5) * step))
    return [at[round((t - lag) / step)] for t in times]


def fixes(times, lag=0.0, off=(0.0, 0.0)):
    return [(i, 1, 0, 0.0, t, 1, 50.0, 8.0, 100.0, e + off[0], n + off[1], 100.0) for i, (t, (e, n)) in enumerate(zip(times, path(times, lag), strict=True))]


def test_delays_between_the_quarters_of_a_second(spark, tmp_path):
    dense, sparse = [k / 4 for k in range(240)], [k * 1.5 + 0.5 for k in range(38)]
    write(spark, tmp_path, gps_ref_enu=(fixes(dense), GPS), starlink_corrected_enu=(fixes(sparse, 0.34, (30.0, -20.0)), GPS))
    (r,) = run(spark, tmp_path, "q_delay_scan")
    assert abs(r["tau"] - 0.34) < 0.03 and r["score"] < 0.3 and r["rmse"] < 0.3 and r["doubt"] == ""
    write(spark, tmp_path, gps_ref_enu=(fixes(dense, 0.34), GPS), euler_raw=(told(1, "deg", math.pi / 180, "deg", [k / 10 for k in range(-20, 620)], lambda t: 2 * math.sin(0.3 * t)), EULER))
    (r,) = run(spark, tmp_path, "q_course_delay")
    assert abs(r["tau"] - 0.34) < 0.03 and r["score"] <= r["p90"] < 0.05 and r["doubt"] == ""


def test_distances_along_the_ray_and_straight_down(spark, tmp_path):
    euler = [r for f, o, per, stated, note in UNITS for r in told(f, o, per, stated, range(4), lambda t: 0.0, note)]
    euler += told(9, "rad", 0.05, "rad", range(4), lambda t: 0.0)  # roll 2 rad and pitch 1 rad: beyond the horizon, where the sign turns
    euler += told(10, "rad", 0.1 / 1.5, "rad", range(4), lambda t: 0.0)  # roll 1.5 rad: near it
    baro = [(100 * f + i, f, 0, 0.0, i + 0.5, 50.0) for f in (1, 2, 3, 4, 5, 9, 10) for i in range(4)]
    write(spark, tmp_path, euler_raw=(euler, EULER), baro_corrected=(baro, "sample_id bigint, flight_id bigint, seg bigint, t double, tr double, u_corr double"))
    rows = run(spark, tmp_path, "q_ray_distance")
    c = math.cos(0.1) * math.cos(0.05)
    for r in rows:
        assert r["ray"] == 50.0
        if r["sample_id"] % 100 == 3 or r["flight_id"] == 10:  # no attitude on either side, or near the horizon
            assert r["vertical"] is None and r["vertical_to_ray"] is None
        elif r["flight_id"] == 9:
            assert abs(r["vertical"] - 50 * math.cos(2) * math.cos(1)) < 1e-4
        else:
            assert abs(r["vertical"] - 50 * c) < 1e-4 and abs(r["vertical_to_ray"] - 50 / c) < 1e-4


def brute_delay(left, right, delay):
    """Right value at t - delay by a line between its neighbours, where both are there."""
    out = {}
    for k, t in left:
        at = t - delay
        below, above = [r for r in right if r[0] <= at], [r for r in right if r[0] >= at]
        if below and above:
            (a, x), (b, y) = below[-1], above[0]
            out[k] = x if a == b else x + (y - x) * (at - a) / (b - a)
    return out


def test_series_read_at_delays_across_shards_and_gaps(spark):
    rng = random.Random(3)
    left = [(k, round(rng.uniform(-20, 220), 3)) for k in range(60)]
    right = sorted((t, rng.gauss(0, 1)) for t in {round(rng.uniform(0, 60), 2) for _ in range(80)} | {round(rng.uniform(150, 200), 2) for _ in range(20)})
    for shard in (10.0, 45.0, 600.0):
        l = spark.createDataFrame([(1, t, float(k)) for k, t in left] + [(2, 5.0, 999.0), (None, 5.0, 998.0), (1, None, 997.0)], "f int, tr double, k double")
        r = spark.createDataFrame([(1, t, x) for t, x in right], "f int, tr double, x double")
        got = {}
        for row in at_delays(l, r, ["f"], "tr", ["x"], [-3.0, 0.0, 0.5, 3.0], shard).collect():
            got.setdefault(row["delay"], {})[int(row["k"])] = row["x_at"]
        for delay in (-3.0, 0.0, 0.5, 3.0):
            want = brute_delay(left, right, delay)
            assert got[delay].keys() == want.keys() and all(abs(got[delay][k] - v) < 1e-9 for k, v in want.items())


def test_percentiles_by_bands(spark):
    rng = np.random.default_rng(8)
    groups = {"small": rng.normal(size=7), "close": 1.7e9 + rng.uniform(0, 1, 20_000), "ties": rng.integers(0, 3, 20_000).astype(float), "heavy": rng.standard_cauchy(20_000), "one": np.array([3.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("small", None), (None, 1.0), (None, 2.0)], "g string, x double")
    probs = {"lo": 0.0, "a": 0.05, "m": 0.5, "b": 0.95, "hi": 1.0}
    rows = {r["g"]: r for r in exact_percentiles(df, ["g"], "x", probs).collect()}
    for g, xs in groups.items():
        assert rows[g]["n"] == len(xs)
        for name, p in probs.items():
            assert rows[g][name] == pytest.approx(np.percentile(xs, 100 * p), rel=1e-12)
    assert rows[None]["m"] == 1.5 and exact_percentiles(df.filter("false"), ["g"], "x", probs).count() == 0
