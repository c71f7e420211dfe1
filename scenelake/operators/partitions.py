"""Clusterings of small sets by their distance matrix, and comparisons of clusterings.

Sets are bounded by the domain (the curves of a scene, the clusters of a model); large sets go
through the DataFrame operators of :mod:`scenelake.operators.shapes`.
"""

from __future__ import annotations

import itertools

import numpy as np

from scenelake.operators import curves as cv


def kmedoids(d: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(labels, medoids) from the first places that are farthest apart; ties go to the smaller place."""
    k = min(k, len(d))
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:
        medoids.append(int(d[:, medoids].min(1).argmax()))
    for _ in range(rounds):
        labels = d[:, medoids].argmin(1)
        new = [
            int(own[d[np.ix_(own, own)].sum(1).argmin()]) if (own := np.flatnonzero(labels == c)).size else medoids[c]
            for c in range(k)
        ]
        if new == medoids:
            break
        medoids = new
    return d[:, medoids].argmin(1), np.array(medoids)


def by_size(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered by falling size of their cluster, ties by the first member."""
    names, first, size = np.unique(labels, return_index=True, return_counts=True)
    order = np.lexsort((first, -size))
    new = np.empty(len(names), int)
    new[order] = np.arange(len(names))
    return new[np.searchsorted(names, labels)]


def silhouettes(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(b - a) / max(a, b) of every place; 0 in clusters of one and where there is one cluster."""
    names = np.unique(labels)
    out = np.zeros(len(d))
    if len(names) < 2:
        return out
    for i in range(len(d)):
        own = np.flatnonzero(labels == labels[i])
        if len(own) > 1:
            a = d[i, own].sum() / (len(own) - 1)
            b = min(d[i, labels == c].mean() for c in names if c != labels[i])
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def sweep(d: np.ndarray, ks: range) -> list[tuple[int, float, float]]:
    """(k, mean silhouette, within-cluster distance) of each number of clusters."""
    out = []
    for k in ks:
        if k <= len(d):
            labels, medoids = kmedoids(d, k)
            out.append((k, float(silhouettes(d, labels).mean()), within_distance(d, labels, medoids)))
    return out


def within_distance(d: np.ndarray, labels: np.ndarray, medoids: np.ndarray) -> float:
    """Sum of squared distances to the own medoid."""
    return float((d[np.arange(len(d)), medoids[labels]] ** 2).sum())


def min_max_ratio(d: np.ndarray, labels: np.ndarray) -> float:
    """Least distance between clusters over the greatest within one."""
    same = labels[:, None] == labels[None]
    off = ~np.eye(len(d), dtype=bool)
    between, within = d[~same], d[same & off]
    return float(between.min() / within.max()) if between.size and within.size and within.max() > 0 else 0.0


def permutation_p(d: np.ndarray, labels: np.ndarray, times: int = 200, seed: int = 42) -> float:
    """Share of shuffled labellings whose mean silhouette is no smaller."""
    draw, own = np.random.default_rng(seed), silhouettes(d, labels).mean()
    return float((1 + sum(silhouettes(d, draw.permutation(labels)).mean() >= own for _ in range(times))) / (1 + times))


def procrustes_kmeans(shapes: list[np.ndarray], k: int, rounds: int = 10, reflect: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """(labels, mean curves): members are turned onto their centre before every mean."""
    unit = [cv.unit(s) for s in shapes]
    d = np.array([[cv.procrustes(a, b, reflect) for b in unit] for a in unit])
    labels, medoids = kmedoids(d, k)
    centres = [unit[m] for m in medoids]
    for _ in range(rounds):
        new = np.array([np.argmin([round(cv.procrustes(s, c, reflect), 9) for c in centres]) for s in unit])
        centres = [
            cv.unit(np.mean([cv.oriented(unit[i], c, reflect) for i in own], 0)) if (own := np.flatnonzero(new == n)).size else c
            for n, c in enumerate(centres)
        ]
        if (new == labels).all():
            break
        labels = new
    return labels, centres


def consensus(d: np.ndarray, k: int, times: int = 20, share: float = 0.8, seed: int = 42) -> np.ndarray:
    """1 less the share of sampled clusterings in which two places fall together, of those with both."""
    draw, n = np.random.default_rng(seed), len(d)
    together, both = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(times):
        own = np.sort(draw.choice(n, max(2, int(share * n)), replace=False)) if n > 1 else np.arange(n)
        labels, _ = kmedoids(d[np.ix_(own, own)], k)
        both[np.ix_(own, own)] += 1
        together[np.ix_(own, own)] += labels[:, None] == labels[None]
    out = 1 - np.divide(together, both, out=np.zeros_like(both), where=both > 0)
    np.fill_diagonal(out, 0)
    return out


def cut_tree(d: np.ndarray, k: int) -> np.ndarray:
    """Labels of average-linkage merging down to ``k`` clusters, by falling size."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > max(1, k):
        _, i, j = min((d[np.ix_(a, b)].mean(), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        groups[i] += groups.pop(j)
    labels = np.empty(len(d), int)
    for n, own in enumerate(groups):
        labels[own] = n
    return by_size(labels)


def zero_one_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cost[i, j]: places that are in cluster i of the first or j of the second labelling, not in both."""
    ia, ib = (x[:, None] == np.arange(x.max() + 1)[None] for x in (a, b))
    return (ia[:, :, None] != ib[:, None, :]).sum(0)


def optimal_match(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of least cost, by augmenting paths over potentials; rows or columns may be left."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, used, came = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[at] = True
            free = np.flatnonzero(~used)
            reduced = c[match[at] - 1, free - 1] - u[match[at]] - v[free]
            better = reduced < least[free]
            least[free[better]], came[free[better]] = reduced[better], at
            to = free[least[free].argmin()]
            step = least[to]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = int(to)
            if match[at] == 0:
                break
        while at:
            match[at], at = match[came[at]], int(came[at])
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def greedy_match(cost: np.ndarray, first: int = 0) -> list[tuple[int, int]]:
    """Rows from ``first`` on, in turn, each with its cheapest column left."""
    left, out = set(range(cost.shape[1])), []
    for k in range(cost.shape[0]):
        i = (first + k) % cost.shape[0]
        if left:
            j = min(left, key=lambda c: (cost[i, c], c))
            left.remove(j)
            out.append((i, j))
    return sorted(out)


def best_greedy_match(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest of the greedy matches from every start."""
    return min((greedy_match(cost, s) for s in range(cost.shape[0])), key=lambda m: (sum(cost[i, j] for i, j in m), m))


def folds_error(points: np.ndarray, k: int, folds: int = 10) -> float:
    """Mean squared distance of held-out points to the nearest centre fitted on the others."""
    own, total = np.arange(len(points)) % folds, 0.0
    for f in range(folds):
        train, test = points[own != f], points[own == f]
        if len(test) and len(train):
            centres = train[np.linspace(0, len(train) - 1, min(k, len(train))).astype(int)].astype(float)
            for _ in range(10):
                at = ((train[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                centres = np.stack([train[at == c].mean(0) if (at == c).any() else centres[c] for c in range(len(centres))])
            total += ((test[:, None] - centres[None]) ** 2).sum(2).min(1).sum()
    return total / max(1, len(points))


def scaled(d: np.ndarray, dims: int) -> np.ndarray:
    """Classical multidimensional scaling; signs are fixed by each axis' greatest value."""
    n = len(d)
    mid = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-mid @ (d * d) @ mid / 2)
    order = np.argsort(-values)[:dims]
    axes = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] + 1e-300)


def spectral(similarity: np.ndarray, k: int) -> np.ndarray:
    """Labels by the first eigenvectors of the normalised Laplacian."""
    degree = similarity.sum(1)
    root = 1 / np.sqrt(np.maximum(degree, 1e-12))
    laplacian = np.diag((degree > 0).astype(float)) - root[:, None] * similarity * root[None]
    _, vectors = np.linalg.eigh(laplacian)
    rows = vectors[:, :k]
    rows = rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-12)
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    return by_size(kmedoids(d.round(9), k)[0])
