"""From pixels and turn rates to velocities, and small conversions of logged values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def focal_px(size_px: float, view_deg: float) -> float:
    """Focal length in pixels of an image side seen under an angle."""
    return size_px / 2 / math.tan(math.radians(view_deg) / 2)


def physical_limits(width_px: float, height_px: float, view_deg: float, height_m: float, most_mps: float, fps: float) -> dict[str, float]:
    """What a camera looking down from a height can see move at most: metres a pixel, pixels a second and pixels a frame along x and y, of square pixels."""
    focal = focal_px(width_px, view_deg)
    across = 2 * height_m * math.tan(math.radians(view_deg) / 2)
    down = 2 * height_m * (height_px / (2 * focal))
    m_x, m_y = across / width_px, down / height_px
    return {"m_per_px_x": m_x, "m_per_px_y": m_y, "flow_x": most_mps / m_x, "flow_y": most_mps / m_y, "dx": most_mps / m_x / fps, "dy": most_mps / m_y / fps}


def clip(x: Column, limit: float) -> Column:
    """x held to plus or minus a limit; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def turn(v: Sequence[Column], rotation: Sequence[Sequence[float]]) -> list[Column]:
    """A vector of three columns turned by a fixed matrix; a missing part is missing only in what it goes into."""
    return [sum((F.lit(float(m)) * c for m, c in zip(row, v, strict=True) if m), F.lit(0.0)) for row in rotation]


def angular_flow(dx: Column, dy: Column, dt: Column, fx: float, fy: float, gyro: Sequence[Column] | None = None) -> tuple[Column, Column]:
    """Flow in radians per second, less what the camera's own turning (angles about x and y in the step) explains."""
    ax, ay = dx / fx, dy / fy
    if gyro is not None:
        ax, ay = ax + gyro[1], ay - gyro[0]
    return F.when(dt > 0, ax / dt), F.when(dt > 0, ay / dt)


def distance_to_ground(measured: Column, roll: Column, pitch: Column, mode: str = "ray", least_cos: float = 0.2) -> Column:
    """Distance along the optical axis, or straight down, from a range along the ray or a vertical height; null near the horizon."""
    c = F.cos(roll) * F.cos(pitch)
    out = {"ray": measured, "vertical": measured * c, "vertical_to_ray": measured / F.when(c != 0, c)}[mode]
    return out if mode == "ray" else F.when(F.abs(c) >= least_cos, out)


def metric_velocity(rate_x: Column, rate_y: Column, distance: Column) -> tuple[Column, Column]:
    """Velocity of a camera over ground, in its own axes: against the flow."""
    return -distance * rate_x, -distance * rate_y


def flag(text: Column, default: float = 0.0) -> Column:
    """1 or 0 of a logged truth value: words, numbers, or nothing."""
    t = F.lower(F.trim(text))
    number = t.try_cast("double")
    known = F.when(t.isin("true", "t", "yes", "y", "on"), 1.0).when(t.isin("false", "f", "no", "n", "off"), 0.0)
    return F.coalesce(known, F.when(~F.isnan(number), number), F.lit(default))


def _nearest_rotations(m: pd.Series) -> pd.Series:
    def one(a):
        if a is None or len(a) != 9 or not np.isfinite(np.asarray(a, float)).all():
            return None
        u, _, v = np.linalg.svd(np.asarray(a, float).reshape(3, 3))
        return (u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v))]) @ v).ravel().tolist()

    return pd.Series([one(a) for a in m])


def nearest_rotation(matrix: Column) -> Column:
    """The rotation (nine numbers by rows) nearest to a matrix, by singular values; null where it is not nine finite numbers."""
    return F.pandas_udf(_nearest_rotations, "array<double>")(matrix)
