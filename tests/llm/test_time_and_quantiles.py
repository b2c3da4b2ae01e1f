import random

import numpy as np
import pytest

pytest.importorskip("tracklane.llm")
from tracklane.llm.nearest_time import nearest_in_time
from tracklane.llm.quantiles import answer, compress, exact, merge, merge_summaries, quantiles, summarise

NAN, INF = float("nan"), float("inf")
SIDE = "id bigint, f bigint, t double, e string, shard int"


def side(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SIDE)


def nearest(spark, left, right, tol, shard=10.0):
    out = nearest_in_time(side(spark, left), side(spark, right), "f", "t", "id", "id", tol, shard)
    return sorted((r["left_id"], r["right_id"]) for r in out.collect())


def brute(left, right, tol):
    out, ok = [], lambda x: x is not None and np.isfinite(x)
    for i, f, t in left:
        best = min(((abs(t - u), j) for j, g, u in right if f is not None and f == g and ok(t) and ok(u) and j is not None), default=None)
        if best and best[0] <= tol and i is not None:
            out.append((i, best[1]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_against_brute_force(spark, seed):
    rng = random.Random(seed)
    grid = [x / 4 for x in range(400)]  # many ties
    make = lambda n, start: [(start + i, rng.choice([1, 1, 1, 2]), rng.choice(grid) + rng.choice([0, 0, 0.1])) for i in range(n)]
    left, right = make(300, 0), make(200, 10_000)
    left += [(9000, None, 1.0), (9001, 1, None), (9002, 1, NAN), (None, 1, 2.0), (9003, 3, 5.0)]
    right += [(19_000, None, 1.0), (19_001, 1, NAN), (19_002, 1, INF), (None, 1, 2.0), (19_003, 1, 9.99), (19_004, 1, 10.01)]
    for tol in (0.05, 0.5, 3.0):
        assert nearest(spark, left, right, tol) == brute(left, right, tol)


def test_nearest_of_empty_sides_and_small_shards(spark):
    assert nearest(spark, [], [(1, 1, 1.0)], 1.0) == [] == nearest(spark, [(1, 1, 1.0)], [], 1.0)
    with pytest.raises(ValueError):
        nearest(spark, [], [], 6.0)


def test_nearest_across_arrow_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(9)
        left = [(i, 1, rng.uniform(0, 60)) for i in range(120)]
        right = [(1000 + i, 1, rng.uniform(0, 60)) for i in range(40)]
        assert nearest(spark, left, right, 2.0, 30.0) == brute(left, right, 2.0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def ranks(values, x):
    return int((values < x).sum()) + 1, int((values <= x).sum())


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_merged_summaries_keep_their_stated_error(kind):
    rng = np.random.default_rng(1)
    draw = {"normal": lambda n: rng.normal(size=n), "ties": lambda n: rng.integers(0, 5, n).astype(float), "heavy": lambda n: rng.standard_cauchy(n)}[kind]
    parts = [draw(n) for n in (1, 2000, 17, 5000, 333, 8000)]
    total = np.concatenate(parts)
    s, n = None, 0
    for p in parts:
        one = compress(exact(p), len(p), 100)
        s, n = (one, len(p)) if s is None else (merge(s, one), n + len(p))
        s = compress(s, n, 100)
    v, lo, hi = s
    for x, a, b in zip(v, lo, hi, strict=True):
        first, last = ranks(total, x)
        assert a <= last and b >= first  # the stated interval meets the true ranks
    for q in (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0):
        x, off = answer(s, n, q)
        target, (first, last) = max(1, int(np.ceil(q * n - 1e-9))), ranks(total, x)
        assert max(first - target, target - last, 0) <= off <= 0.04 * n
    assert v[0] == total.min() and v[-1] == total.max()


def test_quantiles_of_groups_and_of_days_combined(spark):
    rng = np.random.default_rng(2)
    data = [("a" if i % 3 else None, int(i % 5), float(x), 1) for i, x in enumerate(rng.normal(size=6000))]
    data += [("a", 1, NAN, 1), ("a", 1, None, 1), ("z", 9, INF, 1), ("z", 9, 1.0, 1)]
    df = spark.createDataFrame(data, "g string, day int, x double, v int").repartition(5)
    dims = {"g": ["g"], "g,day": ["g", "day"]}
    got = {(r["dimension"], r["group_key"], r["q"]): r for r in quantiles(summarise(df, "x", dims, 200), [0.5, 1.0]).collect()}
    for key, pick in (("a", "a"), ("null", None)):
        v = np.array([x for g, _, x, _ in data if g == pick and x is not None and not np.isnan(x)])
        r = got["g", key, 0.5]
        first, last = ranks(v, r["value"])
        target = int(np.ceil(0.5 * len(v)))
        assert r["n"] == len(v) and max(first - target, target - last, 0) <= r["rank_error"] <= 0.02 * len(v)
    assert got["g", "z", 1.0]["value"] == INF and got["g", "z", 0.5]["value"] == 1.0 and got["g", "z", 0.5]["rank_error"] == 0
    days = [summarise(df.filter(f"day % 2 = {k}"), "x", {"g": ["g"]}, 200) for k in (0, 1)]
    both = {r["group_key"]: r for r in quantiles(merge_summaries(days[0].unionByName(days[1]), 200), [0.5]).collect()}
    assert both["a"]["n"] == got["g", "a", 0.5]["n"] and both["a"]["rank_error"] <= 0.03 * both["a"]["n"]
    assert summarise(df.filter("false"), "x", dims).count() == 0
