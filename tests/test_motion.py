import math

import numpy as np
from pyspark.sql import functions as F

from tracklane.functions import motion


def test_truth_values(spark):
    words = ["True", " y ", "no", "0.5", "nan", "", None, "maybe", "OFF", "1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(motion.flag(F.col("w"), 0.25)).collect()] == [1.0, 1.0, 0.0, 0.5, 0.25, 0.25, 0.25, 0.25, 0.0, 1.0]


def test_flow_of_a_pure_turn_is_no_motion(spark):
    fx = motion.focal_px(384, 40.0)
    assert math.isclose(2 * math.atan(192 / fx), math.radians(40))
    df = spark.range(1)
    rx, ry = motion.angular_flow(F.lit(-0.1 * fx), F.lit(0.0), F.lit(0.5), fx, fx, [F.lit(0.0), F.lit(0.1)])
    vx, vy = motion.metric_velocity(rx, ry, F.lit(100.0))
    r = df.select(vx.alias("x"), vy.alias("y"), motion.clip(F.lit(7.0), 5.0).alias("c"), motion.clip(F.lit(None).cast("double"), 5.0).alias("n")).first()
    assert abs(r["x"]) < 1e-9 and abs(r["y"]) < 1e-9 and r["c"] == 5.0 and r["n"] is None
    modes = [motion.distance_to_ground(F.lit(10.0), F.lit(a), F.lit(0.0), m) for m, a in (("ray", 1.0), ("vertical", 1.0), ("vertical_to_ray", 1.0), ("vertical", 1.5))]
    ray, down, back, flat = df.select(*modes).first()
    assert ray == 10 and math.isclose(down, 10 * math.cos(1)) and math.isclose(back, 10 / math.cos(1)) and flat is None


def test_nearest_rotation(spark):
    m = (np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]) + 0.01 * np.arange(9).reshape(3, 3)).ravel().tolist()
    rows = spark.createDataFrame([(m,), (None,), ([1.0],), ([float("nan")] * 9,)], "m array<double>").select(motion.nearest_rotation(F.col("m"))).collect()
    r = np.array(rows[0][0]).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and math.isclose(np.linalg.det(r), 1) and [x[0] for x in rows[1:]] == [None] * 3
    turned = spark.range(1).select(*motion.turn([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [[0, -1, 0], [1, 0, 0], [0, 0, 1]])).first()
    assert tuple(turned) == (-2.0, 1.0, 3.0)
