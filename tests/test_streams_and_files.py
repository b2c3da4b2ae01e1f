"""Streams must come to what the batch operators say; files must be written once and as they are."""

import hashlib
import json
import random
from functools import partial

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tracklane.operators import recurrence as R
from tracklane.operators.late_events import classify, period_stats, value_counts
from tracklane.sources.contracts import read_csv, read_json, violations
from tracklane.sources.sinks import manifest, write_bundle, write_json, write_log, write_run, write_table
from tracklane.session import ensure_checkpoint_dir
from tracklane.streaming.kernels import stream_sequential, time_slices
from tracklane.streaming.late import latest_periods, period_counts

S = 1_000_000_000


def drip(spark, tmp_path, batches, schema):
    """A stream that gets one file per batch, in order."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i:03}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, _ in enumerate(batches):
        (f,) = (tmp_path / "in" / f"p={i:03}").glob("*.parquet")
        f.rename(flat / f"{i:03}.parquet")
    import os
    import time

    for i, f in enumerate(sorted(flat.iterdir())):
        os.utime(f, (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


def drain(df, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("drained").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table("drained")


def test_stream_of_a_kernel_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    schema = "f int, t double, x double"
    batches = [[(f, b * 10.0 + i, None if rng.random() < 0.2 else rng.gauss(0, 1)) for f in (1, 2) for i in range(5)] for b in range(4)]
    kernel = partial(R.exponential, 3.0)
    got = drain(stream_sequential(drip(spark, tmp_path, batches, schema), ["f"], ["t"], kernel, "y double"), tmp_path, "append")
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    want = R.low_pass(whole, ["f"], "t", [], "x", R.exponential_gain(3.0))
    mine = {(r["f"], r["t"]): r["y"] for r in got.collect()}
    for r in want.collect():
        y = mine[r["f"], r["t"]]
        assert (y is None or y != y) if r["y"] is None else abs(y - r["y"]) < 1e-9
    same = R.sequential(whole, ["f"], ["t"], kernel, "y double")
    assert {(r["f"], r["t"]): r["y"] for r in same.collect()} == pytest.approx(mine, nan_ok=True)


def state_of(rows):
    return {(r["f"], r["period"]): tuple(r[c] for c in ("n", "distinct", "lo", "hi", "median")) for r in rows}


LATE = "f int, m bigint, rec bigint, h bigint, a bigint, x double"


def streamed(spark, tmp_path, batches, **more):
    got, at = [], str(tmp_path / "sent")
    df = period_counts(drip(spark, tmp_path, batches, LATE), "f", "m", "rec", "h", "a", "x", **more)
    q = df.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(at))
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) is not False
    got = latest_periods(spark.read.parquet(at), "f").collect()
    return state_of(got)


def batch_answer(spark, rows):
    events = classify(spark.createDataFrame(rows, LATE), ["f", "m"], "rec", "h", "a", {"x": F.col("x")})
    want = period_stats(value_counts(events, ["f"], "x"), ["f"]).collect()
    return {(r["f"], r["period"]): tuple(r[f"{c}_corrected"] for c in ("n", "distinct", "lo", "hi", "median")) for r in want if r["n_corrected"]}


def test_stream_of_late_events_takes_batches_in_any_order(spark, tmp_path):
    """A record of an early arrival comes after batches of later ones; nothing within the cut-off is lost."""
    rows = lambda *at: [(1, m, m, h * S, a * S, float(m)) for m, h, a in at]
    a, f, g, b = rows((1, 3, 31)), rows((2, 95, 96)), rows((3, 120, 121)), rows((4, 4, 5), (5, 5, 6))
    got = streamed(spark, tmp_path, [a, f, g, b])
    assert got == batch_answer(spark, [*a, *f, *g, *b])
    assert got[1, 0][0] == 3


def test_stream_of_late_events_ends_where_the_batch_does(spark, tmp_path):
    rng = random.Random(2)
    data = []
    for i in range(120):
        h = rng.choice([None, 0, rng.randint(1, 40) * S, rng.randint(1, 40) * S])
        a = (h or rng.randint(1, 40) * S) + rng.choice([0, 1, 15, 30, 90]) * S
        x = rng.choice([None, float("nan"), float(rng.randint(0, 5))])
        data.append((1 + i % 2, i, i, h, a, x))
        if i % 3 == 0:  # redelivered, perhaps in another period and of another value
            data.append((1 + i % 2, i, 1000 + i, h, a + rng.choice([-9, 0, 25]) * S, 7.0))
    rng.shuffle(data)
    got = streamed(spark, tmp_path, [data[i : i + 40] for i in range(0, 160, 40)], shard=16)
    assert got == batch_answer(spark, data)


def test_stream_forgets_after_the_allowance(spark, tmp_path):
    old, new, late = [(1, 1, 1, 3 * S, 4 * S, 1.0)], [(1, 5000 * 16, 2, 9000 * S, 9001 * S, 2.0)], [(1, 2, 3, 5 * S, 6 * S, 3.0)]
    got = streamed(spark, tmp_path, [old, new, new, late], allowance_s=600)
    assert got[1, 0][0] == 1  # what is late beyond the allowance is lost, as stated


def test_slices_bound_what_a_batch_holds_of_a_series(spark):
    df = spark.createDataFrame([(f, float(t)) for f in (1, 2) for t in range(25 if f == 1 else 7)], "f int, t double")
    parts = [p.collect() for p in time_slices(df, ["f"], ["t"], F.floor(F.col("t") / 10), rows=10)]
    assert [max((sum(r["f"] == f for r in p) for f in (1, 2))) for p in parts] == [10, 10, 5]
    assert sorted(r["t"] for p in parts[:1] for r in p if r["f"] == 1) == list(map(float, range(10)))
    assert list(time_slices(df.filter("false"), ["f"], ["t"], F.floor(F.col("t") / 10))) == []


def test_checkpoint_folder_is_the_session_s(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, float("nan"), "b"), (1, float("inf"), None)], "k int, x double, b string")
    write_table(df, str(tmp_path / "t"), by=["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    with pytest.raises(AnalysisException):
        write_table(df, str(tmp_path / "t"))
    write_json(df, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"b": "a", "k": 1, "x": 2.0}, {"b": "b", "k": 2}, {"k": 1}]))
    write_bundle({"one": df, "two": df.drop("b")}, str(tmp_path / "b"), spark.createDataFrame([("one", float("nan")), ("two", 1.5)], "variant string, rmse double"))
    assert spark.read.parquet(str(tmp_path / "b" / "variants")).groupBy("variant").count().count() == 2
    assert {(r["variant"], r["rmse"]) for r in read_json(spark, str(tmp_path / "b" / "metrics"), "variant string, rmse double", whole_files=False).collect()} == {("one", None), ("two", 1.5)}
    listed = read_json(spark, str(tmp_path / "b" / "manifest"), "file string, length bigint, sha256 string", whole_files=False).collect()
    assert listed and all(len(r["sha256"]) == 64 for r in listed)
    (tmp_path / "one.json").write_text('{\n "window": 11,\n "tau": 0.8\n}')
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "one.json"), "window int, tau double").collect()] == [(11, 0.8)]
    write_run(spark, str(tmp_path / "run"), {"window": "11"}, [str(tmp_path / "t")], [str(tmp_path / "j")], "done", 1.25)
    run = read_json(spark, str(tmp_path / "run"), "part string, status string, elapsed_s double, config map<string, string>, sha256 string", whole_files=False).collect()
    assert [(r["status"], r["elapsed_s"], r["config"]) for r in run if r["part"] == "run"] == [("done", 1.25, {"window": "11"})] and {r["part"] for r in run} == {"run", "input", "output"}
    write_log([df.select("k", F.lit(3).alias("t")), df.select("k", F.lit(1).alias("t"), "x")], "t", ["k"], str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 6
    write_table(df.select("k", "x"), str(tmp_path / "c"), form="csv")
    assert read_csv(spark, str(tmp_path / "c"), "k int, x double").filter("k = 1").count() == 2
    sums = {r["file"]: (r["length"], r["sha256"]) for r in manifest(spark, str(tmp_path / "j")).filter("file like '%.json'").collect()}
    for f in (tmp_path / "j").glob("*.json"):
        assert f.stat().st_size == 0 or sums[f.name] == (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest())


def test_contract_names_what_is_wrong(spark, tmp_path):
    spark.createDataFrame([], "a int, b string").write.parquet(str(tmp_path / "t.parquet"))
    got = {tuple(r) for r in violations(spark, str(tmp_path), {"t": {"a": "bigint", "c": "int"}, "u": {"a": "int"}}).collect()}
    assert got == {("t", "a", "is int, not bigint"), ("t", "c", "missing column"), ("t", "", "empty"), ("u", "", "missing table")}
