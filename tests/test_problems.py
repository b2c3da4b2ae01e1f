"""The general problems against plain brute force, and their edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklane.operators.copy_diff import DiffConfig, Field, diff_copies, leaf_checksums, mismatched_leaves
from tracklane.operators.late_events import classify, merge_counts, period_stats, value_counts
from tracklane.operators.regular_grid import GridConfig, regular_grid
from tracklane.operators.spikes import SpikeConfig, flag_readings
from tracklane.operators.units import RADIANS, fit_offsets, to_radians

NAN, INF = float("nan"), float("inf")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


FIELDS = [Field("stamp", "stamp"), Field("v.x"), Field("name", "text")]
COPY = "f bigint, k bigint, stamp bigint, v struct<x:double>, name string, entity int, leaf int"


def copy(spark, data):
    return spark.createDataFrame([(f, k, s, (x,), n, 1, 2) for f, k, s, x, n in data], COPY)


def test_diff_finds_each_kind(spark):
    a = [(1, 1, 10**18, 1.0, "a"), (1, 1, 10**18, 1.0, "a"), (1, 2, 10**18, NAN, None), (1, 3, 0, INF, "c"), (2, 4, None, 2.0, "d"), (None, 5, 5, 5.0, "e"), (3, 9, 5, 1.0, "x")]
    b = [(1, 1, 10**18 + 1000, 1.0005, "a"), (1, 2, 10**18, None, ""), (1, 3, 2000, INF, "c"), (2, 4, 7, 2.0011, "D"), (None, 5, 5, 5.0, "e"), (3, 10, 5, 1.0, "x")]
    got = rows(diff_copies(copy(spark, a), copy(spark, b), "f", "k", FIELDS))
    want = [
        (1, 2, "value", "name"), (1, 3, "value", "stamp"), (2, 4, "value", "name"), (2, 4, "value", "stamp"), (2, 4, "value", "v.x"),
        (3, 10, "missing_in_generated", ""), (3, 9, "missing_in_golden", ""),
    ]
    assert got == sorted(want, key=str)


def test_diff_of_empty_copies(spark):
    empty, one = copy(spark, []), copy(spark, [(1, 1, 1, 1.0, "a")])
    assert rows(diff_copies(empty, empty, "f", "k", FIELDS)) == []
    assert rows(diff_copies(empty, one, "f", "k", FIELDS)) == [(1, 1, "missing_in_generated", "")]
    assert rows(diff_copies(one, empty, "f", "k", FIELDS)) == [(1, 1, "missing_in_golden", "")]


def test_diff_against_brute_force_and_only_bad_leaves_are_compared(spark):
    rng = random.Random(3)
    a = {(f, k): (10**18 + k, rng.uniform(-50, 50), "n") for f in (1, 2) for k in range(3000)}
    b = dict(a)
    for key in rng.sample(sorted(a), 12):
        b[key] = (b[key][0], b[key][1] + rng.choice([0.0004, 0.002, 5.0]), b[key][2])
    for key in rng.sample(sorted(a), 3):
        del b[key]
    flat = lambda d: [(f, k, *v) for (f, k), v in d.items()]
    da, db = copy(spark, flat(a)), copy(spark, flat(b))
    want = [(f, k, "missing_in_golden", "") for f, k in a if (f, k) not in b]
    want += [(f, k, "value", "v.x") for f, k in b if abs(a[f, k][1] - b[f, k][1]) > 0.001]
    assert rows(diff_copies(da, db, "f", "k", FIELDS)) == sorted(want, key=str)
    cfg = DiffConfig()
    bad = mismatched_leaves(leaf_checksums(da, db, "f", "k", FIELDS, cfg), cfg)
    assert 0 < bad.count() <= 15


def angles(spark, data):
    return spark.createDataFrame(data, "sample_id bigint, f bigint, o string, roll double, pitch double, yaw double, angle_unit string, raw_text string, unit int, n int").drop("none")


def test_units_from_every_place(spark):
    rng, data, truth = random.Random(1), [], {}

    def add(f, o, unit, n, stated=None, text=None):
        for _ in range(n):
            r, p, y = rng.gauss(0, 0.1), rng.gauss(0, 0.05), rng.uniform(-3, 3)
            i = len(data) + 1
            k = RADIANS[unit]
            data.append((i, f, o, r / k, p / k, y / k, stated, text, 0, 0))
            truth[i] = (unit, r, p, y)

    add(1, "a", "deg", 40, "Degrees ")
    add(1, "b", "mrad", 40, "millirad")
    add(1, "c", "rad", 40, None, None)
    add(2, "a", "cdeg", 30)  # only the size tells
    add(2, "b", "grad", 1, None, "units: GON")
    add(2, "b", "grad", 9)
    add(2, "c", "turn", 6, "rev")
    add(2, "c", "turn", 4)  # most rows of the stream state it
    add(2, "c", "deg", 1, None, "angles in °")
    n = len(data)
    data += [
        (n + 1, 3, "t", None, NAN, None, None, "RPY(degrees) -7.74/-3.72/-100.66", 0, 0),
        (n + 2, 3, "t", None, None, None, None, "yaw -1.5 rad, pitch 0.25 rad, roll 0.125 rad", 0, 0),
        (n + 3, 3, "t", None, None, None, None, "r -0°30'00\"; 1°07'12\"; -77°10'12\"", 0, 0),
        (n + 4, 3, "t", None, None, None, None, "R -1,53 P -1,88 Y -57,67 (deg*100)", 0, 0),
        (n + 5, 3, "t", None, None, None, None, "no attitude", 0, 0),
        (n + 6, 3, "t", None, None, None, None, None, 0, 0),
        (n + 7, None, None, 0.1, None, 1.0, "rad", "", 0, 0),
    ]
    got = {r["sample_id"]: r for r in to_radians(angles(spark, data), "sample_id", ["f", "o"]).collect()}
    for i, (unit, r, p, y) in truth.items():
        assert got[i]["unit"] == unit, (i, unit, got[i])
        assert math.isclose(got[i]["roll_rad"], r, abs_tol=1e-9) and math.isclose(got[i]["yaw_rad"], y, abs_tol=1e-9)
    assert got[n + 1]["unit"] == "deg" and math.isclose(got[n + 1]["roll_rad"], math.radians(-7.74))
    assert got[n + 2]["unit"] == "rad" and (got[n + 2]["roll_rad"], got[n + 2]["yaw_rad"]) == (0.125, -1.5)
    assert got[n + 3]["unit"] == "deg" and math.isclose(got[n + 3]["roll_rad"], math.radians(-0.5))
    assert got[n + 4]["unit"] == "cdeg" and math.isclose(got[n + 4]["pitch_rad"], math.radians(-0.0188))
    assert n + 5 not in got and n + 6 not in got and got[n + 7]["pitch_rad"] is None
    assert to_radians(angles(spark, []), "sample_id", ["f", "o"]).count() == 0


def test_mixture_finds_the_offsets():
    rng = np.random.default_rng(0)
    unknown = {}
    for u, n in (("rad", 60), ("deg", 30), ("mrad", 20)):
        for x in rng.normal(math.log(0.07) - math.log(RADIANS[u]), 0.2, n):
            unknown[round(x, 4)] = unknown.get(round(x, 4), 0) + 1
    fit = fit_offsets({(math.log(0.07), "rad"): 30}, unknown)
    assert abs(fit["mu"] - math.log(0.07)) < 0.1 and fit["share"]["rad"] > 0.4 and fit["share"]["mrad"] > 0.1


def readings(spark, data):
    return spark.createDataFrame([(f, s, None if o is None else float(o), v, 0, "x") for f, s, o, v in data], "f string, src string, ord double, v double, pos int, block string")


BOUNDS = {"a": (-500.0, 9000.0)}


def flags(spark, data, **cfg):
    out = flag_readings(readings(spark, data), F.floor(F.col("ord") / 100), BOUNDS, SpikeConfig(**cfg))
    return {(r["src"], r["ord"]): r["kind"] for r in out.collect()}


def test_spikes_stuck_and_bounds(spark):
    rng = random.Random(5)
    data, want = [], {}
    for src in ("x", "y"):
        base = 100.0
        for i in range(1500):
            base += 0.3 + (40 if i == 700 else 0)  # a trend and a lasting change of level
            v = base + rng.gauss(0, 1)
            if i in (200, 201, 900):
                v, want[src, float(i)] = v + 80, "spike"
            if 1000 <= i < 1025:
                v = 555.5
                if i > 1000:
                    want[src, float(i)] = "stuck"
            if i in (300, 301):
                v, want[src, float(i)] = (INF if i == 300 else 65535.0), "out"
            if i == 400:
                v = NAN
            data.append(("a", src, i, v))
    data += data[190:210]  # copies
    data += [("a", "x", None, 5.0), ("a", "z", 1, 5.0), ("a", "z", 2, None), ("a", None, 3, 20000.0)]
    want["", 3.0] = "out"
    assert flags(spark, data) == want
    assert flags(spark, data, chunk=64, block_chunks=2) == want  # however a source is cut
    assert flags(spark, []) == {}


def test_runs_of_twenty(spark):
    rng = random.Random(2)
    for n, hits in ((19, 0), (20, 19)):
        data = [("a", "s", i, 7.0 if 100 <= i < 100 + n else rng.gauss(0, 3)) for i in range(300)]
        assert sum(k == "stuck" for k in flags(spark, data).values()) == hits


S = 1_000_000_000
LATE = "m bigint, rec bigint, h bigint, a bigint, v double, period int, arrival string"


def late(spark, data):
    df = spark.createDataFrame([(*r, 0, "x") for r in data], LATE)
    return classify(df, ["m"], "rec", "h", "a", {"x": F.col("v")})


def test_late_outcomes(spark):
    data = [
        (1, 1, 5 * S, 6 * S, 1.0), (1, 2, 5 * S, 90 * S, 9.0),  # redelivered: the first counts
        (2, 3, 5 * S, 12 * S, 2.0), (3, 4, 5 * S, 12 * S - 1, 3.0), (4, 5, 5 * S, 70 * S, 4.0), (5, 6, 5 * S, 70 * S - 1, 5.0),
        (6, 7, None, 31 * S, 6.0), (7, 8, 0, 31 * S, None), (8, 9, 32 * S + 1, 31 * S, NAN), (9, 10, 32 * S, 31 * S, 8.0),
        (10, 11, 5 * S, None, 1.0), (None, 12, 5 * S, 6 * S, 2.0), (11, 13, 2**63 - 1, 31 * S, 7.0), (12, 14, 1, 2**63 - 1, 7.0),
    ]
    got = {r["rec"]: (r["outcome"], r["period"] // S) for r in late(spark, data).collect()}
    assert got == {
        1: ("in_time", 0), 3: ("corrects", 0), 4: ("in_time", 0), 5: ("dropped", 0), 6: ("corrects", 0), 7: ("in_time", 30), 8: ("in_time", 30),
        9: ("in_time", 30), 10: ("in_time", 30), 12: ("in_time", 0), 13: ("in_time", 30),
    }
    assert late(spark, []).count() == 0


def test_period_stats_by_brute_force_and_merged_by_day(spark):
    rng = random.Random(4)
    data = [(i, i, (h := rng.randint(1, 60) * S), h + rng.choice([0, 5, 15, 40, 90]) * S, float(rng.randint(0, 6))) for i in range(400)]
    state = value_counts(late(spark, data), [], "x")
    halves = [value_counts(late(spark, data[i::2]), [], "x") for i in (0, 1)]
    assert rows(merge_counts(*halves)) == rows(state.select("period", "v", "n_first", "n_all"))
    ev = pd.DataFrame([r.asDict() for r in late(spark, data).collect()])
    for r in period_stats(state, []).collect():
        kept = ev[(ev.period == r["period"]) & (ev.outcome != "dropped")]
        first = kept[kept.outcome == "in_time"].x.sort_values().tolist()
        every = kept.x.sort_values().tolist()
        assert (r["n_corrected"], r["distinct_corrected"], r["median_corrected"]) == (len(every), len(set(every)), every[(len(every) - 1) // 2])
        assert r["n_first"] == len(first) and r["median_first"] == (first[(len(first) - 1) // 2] if first else None)


GRID = "s string, tr double, v double, cell int, shard string"


def grid(spark, data, **cfg):
    df = spark.createDataFrame([(s, t, v, 0, "x") for s, t, v in data], GRID)
    return {(r["s"], r["cell"]): (r["status"], r["value"], r["n"]) for r in regular_grid(df, ["s"], "tr", "v", GridConfig(**cfg)).collect()}


@pytest.mark.parametrize("shard", [3, 512])
def test_grid_fills_short_gaps_and_marks_long_ones(spark, shard):
    data = [("a", 0.5, 1.0), ("a", 0.9, 3.0), ("a", 3.2, 8.0), ("a", 20.0, 5.0), ("a", 21.0, NAN), ("a", None, 4.0), ("a", NAN, 4.0), ("a", 22.0, None), (None, 7.0, 1.0), ("b", 5.0, NAN), ("c", -1.5, INF)]
    got = grid(spark, data, shard_cells=shard, interpolate_up_to=5)
    want = {("a", 0): ("read", 2.0, 2), ("a", 1): ("filled", 4.0, 0), ("a", 2): ("filled", 6.0, 0), ("a", 3): ("read", 8.0, 1), ("a", 20): ("read", 5.0, 1), (None, 7): ("read", 1.0, 1), ("c", -2): ("read", INF, 1)}
    want |= {("a", c): ("gap", None, 0) for c in range(4, 20)}
    assert got == want
    assert grid(spark, []) == {}


def test_notes_in_other_words_and_on_rows_with_angles(spark):
    schema = "sample_id bigint, flight_id bigint, origin string, roll double, pitch double, yaw double, angle_unit string, raw_text string"
    rows = []
    for f, note, held in ((1, "every attitude that follows is in gon", False), (2, "default unit is mrad", True), (3, "angles in deg", True), (4, "centidegrees", False)):
        rows += [(100 * f + i, f, "x", 2.0, 1.0, 3.0, None, None) for i in range(4)]
        rows.append((100 * f + 9, f, "x", *((2.0, 1.0, 3.0) if held else (None,) * 3), None, note))
    got = {r["sample_id"]: (r["unit"], r["unit_from"]) for r in to_radians(spark.createDataFrame(rows, schema), "sample_id", ["flight_id", "origin"]).collect()}
    assert {got[100 + i] for i in range(4)} == {("grad", "note")} and 109 not in got
    assert {got[200 + i] for i in range(4)} == {("mrad", "note")} == {got[209]}
    assert got[309] == ("deg", "row") and {got[300 + i][1] for i in range(4)} == {"size"}
    assert {got[400 + i] for i in range(4)} == {("cdeg", "note")}


def test_a_version_between_two_others_sends_its_range_down(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0), (1, 5, 3.0), (1, 900, 1.0)], "e bigint, k bigint, x double")
    b = a.filter("x <> 2.0")
    bad = mismatched_leaves(leaf_checksums(a, b, "e", "k", [Field("x")], DiffConfig()), DiffConfig())
    assert [tuple(r) for r in bad.collect()] == [(1, 5 >> DiffConfig().leaf_bits)]
    assert diff_copies(a, b, "e", "k", [Field("x")]).count() == 0  # the least row of the key stands for it on both sides
