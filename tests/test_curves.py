"""Curves and clusterings against brute force and closed forms."""

import itertools

import numpy as np
import pytest

from scenelake.operators import curves as cv
from scenelake.operators import partitions as pt

RNG = np.random.default_rng(3)


def turned(curve, angle):
    c, s = np.cos(angle), np.sin(angle)
    return curve @ np.array([[c, s], [-s, c]])


def test_procrustes_is_blind_to_place_size_and_turn():
    a = RNG.normal(size=(30, 2))
    b = turned(a, 1.1) * 3 + 7
    assert cv.procrustes(a, b) == pytest.approx(0, abs=1e-7)
    mirrored = b * [1, -1]
    assert cv.procrustes(a, mirrored, reflect=True) == pytest.approx(0, abs=1e-7) and cv.procrustes(a, mirrored) > 0.1
    c = RNG.normal(size=(30, 2))
    grid = min(np.sqrt(((turned(cv.unit(a), x) - cv.unit(c)) ** 2).sum()) for x in np.linspace(0, 2 * np.pi, 20001))
    assert cv.procrustes(a, c) == pytest.approx(grid, abs=1e-5) == cv.procrustes(c, a)
    assert cv.joint_procrustes([a, c], [c, a]) == pytest.approx(0, abs=1e-7)
    assert cv.with_speed(a, a, 2.0) == pytest.approx(0, abs=1e-7) and cv.with_speed(a, 2 * a, 1.0) > 0.5


def test_cubics_and_pieces():
    t = np.arange(40.0)
    one = np.stack([t**3 / 1e4, 5 - t], 1)
    assert cv.cubic(t, one) == pytest.approx(np.array([np.polyfit(t, one[:, c], 3)[::-1] for c in range(2)]).T, abs=1e-9)
    assert cv.bisected(t, one, 1e-6) == [0, 39] == cv.best_bounds(t, one)
    kink = np.stack([t, np.abs(t - 20) * 5], 1)
    assert 20 in cv.bisected(t, kink, 1e-3) and cv.pruned(t, kink, [0, 10, 20, 30, 39], 1e-3) == [0, 20, 39]
    assert cv.fitted(t, kink, [0, 20, 39]) == pytest.approx(kink, abs=1e-6)
    assert cv.merged([0, 3, 8, 12, 20, 39]) == [0, 8, 20, 39] and cv.merged([0, 10, 36, 39]) == [0, 10, 39] and cv.merged([0, 3]) == [0, 3]
    assert cv.split_times(np.array([0, 4, 5, 9]), [0, 5, 9]).tolist() == [0, 0, 1, 1]
    assert cv.resampled(t, kink)[[0, 100]] == pytest.approx(kink[[0, 39]]) and cv.resampled_fit(t, one, [0, 39]).shape == (101, 2)
    assert cv.piecewise_procrustes(t, kink, turned(kink, 0.4), [0, 20, 39]) == pytest.approx(0, abs=1e-6)
    assert cv.angle(0, -1) == pytest.approx(1.5 * np.pi) and cv.angle(-1, 0) == pytest.approx(np.pi)


def test_warping_and_windows():
    a, b = RNG.normal(size=(7, 2)), RNG.normal(size=(5, 2))

    def brute(i, j):
        c = np.sqrt(((a[i] - b[j]) ** 2).sum())
        if i == j == 0:
            return c
        return c + min(brute(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0)

    assert cv.warping(a, b) == pytest.approx(brute(6, 4)) and cv.warping(a, np.repeat(a, 2, 0)) == pytest.approx(0)
    assert cv.warping(a, b, speed=1.0) >= cv.warping(a, b)
    x, y = cv.to_shorter(a, b, 1)
    assert len(x) == len(y) == 5 and any((a[i : i + 5] == x).all() for i in range(3)) and (y == b).all()
    e = cv.synthetic_encounters(3, 1)
    assert e.shape == (3, 2, 101, 2) and (e == cv.synthetic_encounters(3, 1)).all() and np.isfinite(e).all()


def test_clusterings():
    points = np.concatenate([RNG.normal(size=(12, 2)) * 0.1 + c for c in ((0, 0), (5, 0), (0, 5))])[RNG.permutation(36)]
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    truth = np.array([np.argmin([np.hypot(*(p - c)) for c in ((0, 0), (5, 0), (0, 5))]) for p in points])
    labels, medoids = pt.kmedoids(d, 3)
    assert min(zip(*np.unique(labels, return_counts=True)))[1] == 12
    assert pt.silhouettes(d, labels).min() > 0.9 and pt.min_max_ratio(d, labels) > 5 and pt.permutation_p(d, labels, 50) < 0.05
    best = max(pt.sweep(d, range(2, 6)), key=lambda r: r[1])
    assert best[0] == 3 and best[2] == pytest.approx(pt.within_distance(d, labels, medoids))
    cost = pt.zero_one_costs(labels, truth)
    assert sum(cost[i, j] for i, j in pt.optimal_match(cost)) == 0 == sum(cost[i, j] for i, j in pt.best_greedy_match(cost))
    for other in (pt.cut_tree(d, 3), pt.cut_tree(pt.consensus(d, 3), 3), pt.spectral(np.exp(-d), 3)):
        c = pt.zero_one_costs(other, truth)
        assert sum(c[i, j] for i, j in pt.optimal_match(c)) == 0
    assert pt.by_size(np.array([5, 5, 9, 2, 2, 2])).tolist() == [1, 1, 2, 0, 0, 0]
    assert pt.folds_error(points, 3) < 0.2 < pt.folds_error(points, 1)
    flat = pt.scaled(d, 2)
    assert np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(2)) == pytest.approx(d, abs=1e-6)
    shapes = [turned(s, x) for x in (0, 1, 2, 3) for s in (np.c_[np.arange(9.0), np.zeros(9)], np.c_[np.arange(9.0), np.arange(9.0) ** 2])]
    got, centres = pt.procrustes_kmeans(shapes, 2)
    assert len(set(got[::2])) == len(set(got[1::2])) == 1 != len(set(got)) and len(centres) == 2


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3)])
def test_matching_equals_all_assignments(shape):
    for _ in range(20):
        cost = RNG.integers(0, 20, shape)
        small = min(shape)
        grid = cost if shape[0] <= shape[1] else cost.T
        want = min(sum(grid[i, p[i]] for i in range(small)) for p in itertools.permutations(range(max(shape)), small))
        got = pt.optimal_match(cost)
        assert sum(cost[i, j] for i, j in got) == want and len(got) == small
