"""Geometry and calculus as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

KM_PER_MILE = 1.609344


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def exact_mean(x: Column, digits: int = 6) -> Column:
    """Mean of values with so many decimals, by integer sums: the same in every order."""
    return F.sum(F.round(x * 10**digits).cast("long")) / F.count(x) / F.lit(float(10**digits))


def round_(x: Column | str, digits: int) -> Column:
    """``x`` rounded half away from zero as DuckDB does it: the product is rounded, not the decimal form,
    so that ties fall alike."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10.0**digits) / F.lit(10.0**digits)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As :func:`round_`, of an array."""
    v = np.abs(x) * 10.0**digits
    whole = np.floor(v)
    return np.copysign(whole + (v - whole >= 0.5), x) / 10.0**digits


def arctan2(y: Column, x: Column) -> Column:
    """The arc tangent of the C library, which SQL takes: Java's may differ in the last bit, and that
    decides on which side of an edge an angle falls."""

    @F.arrow_udf("double")
    def angle(ys: pa.Array, xs: pa.Array) -> pa.Array:
        # not numpy's, which has its own for some processors
        both = zip(ys.to_pylist(), xs.to_pylist(), strict=True)
        return pa.array([None if b is None or a is None else math.atan2(b, a) for b, a in both], pa.float64())

    return angle(y, x)


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """(x cos - y sin, x sin + y cos)."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    turned = angle + math.pi
    return turned - 2 * math.pi * F.floor(turned / (2 * math.pi)) - math.pi


def heading_difference(a: Column, b: Column) -> Column:
    """Degrees between two headings in degrees, folded to [0, 180]."""
    return F.abs(F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0)


def gradient(x: Column, w: WindowSpec, h: float) -> Column:
    """Central differences, one-sided at both ends; null for a single row."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return (
        F.when(before.isNull(), (after - x) / h)
        .when(after.isNull(), (x - before) / h)
        .otherwise((after - before) / (2 * h))
    )


def backward(x: Column, w: WindowSpec, rate: float) -> Column:
    """Differences to the row before, times ``rate``; the first takes the second's value."""
    return F.coalesce((x - F.lag(x).over(w)) * rate, (F.lead(x).over(w) - x) * rate)


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _on(ax, ay, bx, by, cx, cy) -> Column:
    return cx.between(F.least(ax, bx), F.greatest(ax, bx)) & cy.between(F.least(ay, by), F.greatest(ay, by))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd share a point; touching counts."""
    s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    return (
        ((s1 != s2) & (s3 != s4))
        | ((s1 == 0) & _on(ax, ay, bx, by, cx, cy))
        | ((s2 == 0) & _on(ax, ay, bx, by, dx, dy))
        | ((s3 == 0) & _on(cx, cy, dx, dy, ax, ay))
        | ((s4 == 0) & _on(cx, cy, dx, dy, bx, by))
    )


def miles_per_hour(x: Column) -> Column:
    """mph to m/s."""
    return x * (KM_PER_MILE * 1000 / 3600)


def inverse(x: Column) -> Column:
    """1/x with infinity for zero and null for null."""
    return F.when(x == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), x))


def nms_radius(length: Column) -> Column:
    """Suppression radius from the straight length of the best mode."""
    return F.least(F.lit(3.5), F.greatest(F.lit(2.5), (length - 10) / 40 * 1.5 + 2.5))


def sine_embedding(x: Column, dim: int, base: float = 10000.0, scale: float = 2 * math.pi) -> Column:
    """Array of ``dim`` values: sine at even and cosine at odd places of falling frequencies."""

    def value(i: int) -> Column:
        angle = x * scale / base ** (2 * (i // 2) / dim)
        return F.sin(angle) if i % 2 == 0 else F.cos(angle)

    return F.array(*(value(i) for i in range(dim)))


def gaussian_nll(dx: Column, dy: Column, log_sx: Column, log_sy: Column, rho: Column) -> Column:
    """Negative log-likelihood of a bivariate Gaussian, without its constant; deviations clipped."""
    lx = F.least(F.greatest(log_sx, F.lit(-1.609)), F.lit(5.0))
    ly = F.least(F.greatest(log_sy, F.lit(-1.609)), F.lit(5.0))
    r = F.least(F.greatest(rho, F.lit(-0.5)), F.lit(0.5))
    zx, zy = dx / F.exp(lx), dy / F.exp(ly)
    return lx + ly + F.log(1 - r * r) / 2 + (zx * zx + zy * zy - 2 * r * zx * zy) / (2 * (1 - r * r))
