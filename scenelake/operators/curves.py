"""Curves as arrays of points: alignment, cubic pieces, warping, resampling.

Everything here is on numpy arrays of one curve or of one pair, rows being points and columns x, y or
any dimensions; the grouped operators of :mod:`scenelake.operators.shapes` apply it inside Spark.
"""

from __future__ import annotations

import math

import numpy as np

#: Points of a resampled curve; least points of a piece.
POINTS = 101
LEAST = 6


def angle(x: float, y: float) -> float:
    """Arctangent of y / x put into its quadrant, in [0, 2 pi); 0 at the origin."""
    return math.atan2(y, x) % (2 * math.pi)


def unit(curve: np.ndarray) -> np.ndarray:
    """Centred and of norm one; a single place stays at the origin."""
    mid = curve - curve.mean(0)
    size = np.sqrt((mid * mid).sum())
    return mid / size if size > 0 else mid


def rotation(curve: np.ndarray, to: np.ndarray, reflect: bool = False) -> np.ndarray:
    """The rotation, or with ``reflect`` the rotation or reflection, that brings centred ``curve``
    nearest to centred ``to`` when applied from the right."""
    u, s, vt = np.linalg.svd(curve.T @ to)
    if not reflect and np.linalg.det(u @ vt) < 0:
        u[:, -1] = -u[:, -1]
    return u @ vt


def procrustes(a: np.ndarray, b: np.ndarray, reflect: bool = False) -> float:
    """Distance of unit curves after the best rotation: the same in both orders."""
    a, b = unit(a), unit(b)
    return float(np.sqrt(max(0.0, ((a @ rotation(a, b, reflect) - b) ** 2).sum())))


def with_speed(a: np.ndarray, b: np.ndarray, weight: float, reflect: bool = False) -> float:
    """Procrustes distance plus ``weight`` times the mean difference of point-to-point speeds."""
    va, vb = (np.sqrt((np.diff(c, axis=0) ** 2).sum(1)) for c in (a, b))
    return procrustes(a, b, reflect) + weight * float(np.abs(va - vb).mean()) if len(a) > 1 else procrustes(a, b, reflect)


def joint_procrustes(a: list[np.ndarray], b: list[np.ndarray], reflect: bool = False) -> float:
    """Distance of two encounters, each of two curves turned together; the nearer of both orders."""
    straight = procrustes(np.vstack(a), np.vstack(b), reflect)
    return min(straight, procrustes(np.vstack(a[::-1]), np.vstack(b), reflect))


def oriented(curve: np.ndarray, to: np.ndarray, reflect: bool = False) -> np.ndarray:
    """``curve`` centred and turned onto centred ``to``."""
    mid = curve - curve.mean(0)
    return mid @ rotation(mid, to - to.mean(0), reflect)


def cubic(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of the least-squares cubic of each column; fewer than four points
    give a lower degree, with zeros above."""
    degree = min(3, len(t) - 1)
    fit, *_ = np.linalg.lstsq(np.vander(t, degree + 1, increasing=True), values, rcond=None)
    return np.concatenate((fit, np.zeros((3 - degree, *fit.shape[1:]))))


def evaluated(coefficients: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.vander(t, 4, increasing=True) @ coefficients


def cubic_error(t: np.ndarray, values: np.ndarray) -> float:
    """Sum of squared residuals of the cubics over a span, in time scaled to it."""
    own = (t - t[0]) / max(1e-9, t[-1] - t[0])
    return float(((evaluated(cubic(own, values), own) - values) ** 2).sum())


def bisected(t: np.ndarray, values: np.ndarray, tolerance: float, least: int = LEAST) -> list[int]:
    """Boundaries by halving: a span whose cubics miss ``tolerance`` is cut where both halves fit best,
    and each half likewise, down to ``least`` points."""

    def cut(a: int, b: int) -> list[int]:
        if b - a + 1 < 2 * least or cubic_error(t[a : b + 1], values[a : b + 1]) <= tolerance:
            return []
        places = range(a + least - 1, b - least + 2)
        best = min(places, key=lambda c: cubic_error(t[a : c + 1], values[a : c + 1]) + cubic_error(t[c : b + 1], values[c : b + 1]))
        return [*cut(a, best), best, *cut(best, b)]

    return [0, *cut(0, len(t) - 1), len(t) - 1] if len(t) > 1 else [0]


def pruned(t: np.ndarray, values: np.ndarray, bounds: list[int], tolerance: float) -> list[int]:
    """Boundaries dropped from the left while the cubics over both spans beside them fit ``tolerance``;
    several columns are judged jointly."""
    out = list(bounds)
    at = 1
    while at < len(out) - 1:
        a, b = out[at - 1], out[at + 1]
        if cubic_error(t[a : b + 1], values[a : b + 1]) <= tolerance:
            del out[at]
        else:
            at += 1
    return out


def pieces_error(t: np.ndarray, values: np.ndarray, bounds: list[int]) -> float:
    return sum(cubic_error(t[a : b + 1], values[a : b + 1]) for a, b in zip(bounds, bounds[1:]))


def best_bounds(t: np.ndarray, values: np.ndarray, tolerances: tuple[float, ...] = (1e-3, 0.1, 1.0, 2.0, 4.0, 8.0)) -> list[int]:
    """Boundaries under the tolerance with the least error plus number of boundaries."""
    grid = bisected(t, values, min(tolerances))
    found = [pruned(t, values, grid, x) for x in tolerances]
    return min(found, key=lambda b: pieces_error(t, values, b) + len(b))


def merged(bounds: list[int], least: int = LEAST) -> list[int]:
    """Boundaries less than ``least`` points after the one kept before are dropped; the last stays."""
    out = bounds[:1]
    for b in bounds[1:-1]:
        if b - out[-1] >= least:
            out.append(b)
    if len(bounds) > 1:
        if len(out) > 1 and bounds[-1] - out[-1] < least:
            out.pop()
        out.append(bounds[-1])
    return out


def piece_models(t: np.ndarray, values: np.ndarray, bounds: list[int]) -> list[np.ndarray]:
    """Cubic coefficients of every piece, in time from its start."""
    return [cubic(t[a : b + 1] - t[a], values[a : b + 1]) for a, b in zip(bounds, bounds[1:])]


def fitted(t: np.ndarray, values: np.ndarray, bounds: list[int], at: np.ndarray | None = None) -> np.ndarray:
    """Values of the pieces at times ``at``, those of the points if not given."""
    at = t if at is None else at
    models = piece_models(t, values, bounds)
    own = split_times(at, [float(t[b]) for b in bounds])
    return np.stack([evaluated(models[i], np.array([x - t[bounds[i]]]))[0] for i, x in zip(own, at)])


def split_times(times: np.ndarray, bounds: list[float]) -> np.ndarray:
    """The piece [bounds[i], bounds[i+1]) that each time lies in; the last holds its end."""
    return np.clip(np.searchsorted(bounds, times, side="right") - 1, 0, max(0, len(bounds) - 2))


def resampled(t: np.ndarray, values: np.ndarray, points: int = POINTS) -> np.ndarray:
    """Linear interpolation at equal times from first to last."""
    at = np.linspace(t[0], t[-1], points)
    return np.stack([np.interp(at, t, values[:, c]) for c in range(values.shape[1])], 1)


def resampled_fit(t: np.ndarray, values: np.ndarray, bounds: list[int], points: int = POINTS) -> np.ndarray:
    """The pieces' cubics at equal times from first to last."""
    return fitted(t, values, bounds, np.linspace(t[0], t[-1], points))


def piecewise_procrustes(t: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: list[int], mean: bool = False, reflect: bool = False) -> float:
    """Procrustes distances over the pieces between common boundaries, summed or averaged."""
    own = [procrustes(a[i : j + 1], b[i : j + 1], reflect) for i, j in zip(bounds, bounds[1:]) if j - i >= 2]
    return float(np.mean(own) if mean else np.sum(own)) if own else 0.0


def to_shorter(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both curves at the length of the shorter: a window of the longer, drawn by ``seed``."""
    n = min(len(a), len(b))
    draw = np.random.default_rng(seed)
    window = lambda c: c[(at := int(draw.integers(0, len(c) - n + 1))) : at + n]
    return window(a), window(b)


def warping(a: np.ndarray, b: np.ndarray, speed: float = 0.0) -> float:
    """Dynamic time warping cost of two curves; ``speed`` weighs the difference of speeds in a step's cost."""
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    if speed:
        va, vb = (np.sqrt((np.diff(c, axis=0, prepend=c[:1]) ** 2).sum(1)) for c in (a, b))
        cost = cost + speed * np.abs(va[:, None] - vb[None])
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0.0
    for i in range(1, len(a) + 1):
        row, up, c = total[i], total[i - 1], cost[i - 1]
        least = np.minimum(up[1:], up[:-1])
        for j in range(1, len(b) + 1):
            row[j] = c[j - 1] + min(least[j - 1], row[j - 1])
    return float(total[-1, -1])


def synthetic_encounters(n: int, seed: int, points: int = POINTS, scale: float = 0.2, noise: float = 0.05) -> np.ndarray:
    """(n, 2, points, 2): pairs of smooth random curves of a Gaussian process, turned at random, with noise."""
    draw = np.random.default_rng(seed)
    t = np.linspace(0, 1, points)
    kernel = np.exp(-((t[:, None] - t[None]) ** 2) / (2 * scale * scale)) + 1e-8 * np.eye(points)
    root = np.linalg.cholesky(kernel)
    curves = np.einsum("ij,ncjd->ncid", root, draw.normal(size=(n, 2, points, 2)))
    turns = draw.uniform(0, 2 * np.pi, n)
    turn = np.stack([np.stack([np.cos(turns), np.sin(turns)], 1), np.stack([-np.sin(turns), np.cos(turns)], 1)], 1)
    return np.einsum("ncid,nde->ncie", curves, turn) + noise * draw.normal(size=curves.shape)
