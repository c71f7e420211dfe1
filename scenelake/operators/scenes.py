"""Pairs of agents and conflict points as matrices of a scene.

A scene's agents and steps are bounded by the domain, so all its pairs at all steps are a few small
matrices.  Only steps go through the exchange, once, and a row for each pair comes out; joins by step
would send a row for each pair and step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators.kinematics import AGENT

#: Scenarios with ids in one block of so many meet their map together.
BLOCK = 1024
#: Rows of a temporary matrix.
PART = 4096


def blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("scenario_id") / BLOCK))


def with_maps(tracks: DataFrame, maps: DataFrame, around: DataFrame, *columns: str):
    """Valid steps cogrouped by map and block of scenarios with the rows ``around`` (map_id, ...) of the
    map: a map's rows go once to each block of scenarios, not to each scenario."""
    own = blocks(tracks.where("valid").select(*AGENT, "t", "x", "y", *columns)).join(maps, "scenario_id")
    here = blocks(maps).select("map_id", "block").distinct()
    return own.groupBy("map_id", "block").cogroup(around.join(here, "map_id").groupBy("map_id", "block"))


def _scenes(steps: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    if not len(steps):  # a block of a map without a valid step
        return
    steps = steps.sort_values(["scenario_id", "agent_id", "t"])
    ids, first = np.unique(steps["scenario_id"].to_numpy(), return_index=True)
    for scene, a, b in zip(ids, first, np.append(first[1:], len(steps)), strict=True):
        yield scene, steps.iloc[a:b]


class _Agents:
    """Columns as matrices of agents and steps; not a number where an agent has no valid step."""

    def __init__(self, rows: pd.DataFrame, n: int, columns: tuple[str, ...]):
        self.ids, a = np.unique(rows["agent_id"].to_numpy(), return_inverse=True)
        t = rows["t"].to_numpy()
        self.valid = np.zeros((len(self.ids), n), bool)
        self.valid[a, t] = True
        for c in columns:
            m = np.full(self.valid.shape, np.nan)
            m[a, t] = rows[c].to_numpy(float)
            setattr(self, c, m)

    def with_previous(self) -> None:
        """px, py: the valid position before."""
        at = np.where(self.valid, np.arange(self.valid.shape[1]), -1)
        last = np.maximum.accumulate(at, axis=1)
        before = np.concatenate([np.full((len(at), 1), -1), last[:, :-1]], axis=1)
        for c in "xy":
            m = np.take_along_axis(getattr(self, c), np.maximum(before, 0), axis=1)
            setattr(self, f"p{c}", np.where(before >= 0, m, np.nan))

    def nearest(self, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances by agent, point and step; the least; its first step)."""
        d = np.sqrt((self.x[:, None] - cx[:, None]) ** 2 + (self.y[:, None] - cy[:, None]) ** 2)
        known = np.where(np.isnan(d), np.inf, d)
        return d, known.min(axis=2), known.argmin(axis=2)


def _around(rows: pd.DataFrame, points: pd.DataFrame, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and places of the points that lie no farther than ``radius`` around the steps."""
    cx, cy, r = points["cx"].to_numpy(), points["cy"].to_numpy(), radius + 1e-3
    x, y = rows["x"], rows["y"]
    kept = (cx >= x.min() - r) & (cx <= x.max() + r) & (cy >= y.min() - r) & (cy <= y.max() + r)
    return points["cp_id"].to_numpy()[kept], cx[kept], cy[kept]


def nearest_to_points(tracks: DataFrame, maps: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(agent, cp_id, cx, cy, d, t): the first step of least distance to each point that an agent
    comes within ``radius`` of.

    ``maps``: (scenario_id, map_id); ``points``: (map_id, cp_id, cx, cy).
    """
    schema = "scenario_id long, agent_id long, cp_id long, cx double, cy double, d double, t int"

    def block(steps: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        for scene, rows in _scenes(steps):
            ids, cx, cy = _around(rows, near, radius)
            if not len(ids):
                continue
            a = _Agents(rows, rows["t"].max() + 1, ("x", "y"))
            _, least, at = a.nearest(cx, cy)
            n, c = np.nonzero(least <= radius)
            out.append(pd.DataFrame({"scenario_id": scene, "agent_id": a.ids[n], "cp_id": ids[c], "cx": cx[c], "cy": cy[c], "d": least[n, c], "t": at[n, c]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["scenario_id", "agent_id", "cp_id", "cx", "cy", "d", "t"])

    return with_maps(tracks, maps, points).applyInPandas(block, schema)


def _turned(bearing, heading):
    v = bearing - heading + 540.0
    return abs(v - 360.0 * np.floor(v / 360.0) - 180.0)


def _agrees(by: np.ndarray, bx: np.ndarray, hy: np.ndarray, hx: np.ndarray, limit: float) -> np.ndarray:
    """Degrees between direction (bx, by) and heading (hx, hy); those next to ``limit`` by the C library,
    as SQL has them, since there the last bit decides."""
    per = 180.0 / math.pi
    deg = _turned(np.arctan2(by, bx) * per, np.arctan2(hy, hx) * per)
    for at in zip(*np.nonzero(np.abs(deg - limit) < 1e-9), strict=True):
        deg[at] = _turned(math.atan2(by[at], bx[at]) * per, math.atan2(hy[at], hx[at]) * per)
    return deg


def _meet(a: _Agents, b: _Agents, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the last segments of i and j share a point; touching counts."""
    ax, ay, bx, by = a.px[i], a.py[i], a.x[i], a.y[i]
    cx, cy, dx, dy = b.px[j], b.py[j], b.x[j], b.y[j]

    def side(ax, ay, bx, by, cx, cy):
        return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    def on(ax, ay, bx, by, cx, cy):
        return (cx >= np.fmin(ax, bx)) & (cx <= np.fmax(ax, bx)) & (cy >= np.fmin(ay, by)) & (cy <= np.fmax(ay, by))

    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    known = ~np.isnan(s1 + s2 + s3 + s4)
    return (
        (known & (s1 != s2) & (s3 != s4))
        | ((s1 == 0) & on(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & on(ax, ay, bx, by, dx, dy))
        | ((s3 == 0) & on(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & on(cx, cy, dx, dy, bx, by))
    )


def _least(m: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """The least known value of the rows of ``m`` by the pair ``at`` that each belongs to."""
    out = np.full(size, np.nan)
    np.fmin.at(out, at, np.fmin.reduce(m, axis=1))
    return out


MEASURES = ("n_common", "n_aligned", "min_d", "thw", "ttc", "drac", "thw_pos", "ttc_pos", "collisions", "mttcp", "scene_mttcp")
_COLUMNS = ("vx", "vy", "speed", "heading", "length")


def _measured(a: _Agents, b: _Agents, related: np.ndarray, points, within: float, angle: float, radius: float, e1: float, e2: float) -> dict:
    i, j = np.nonzero(related)
    both = a.valid[i] & b.valid[j]
    kept = both.any(axis=1)
    i, j, both = i[kept], j[kept], both[kept]
    n = both.shape[1]
    if not len(i):
        return {}
    xi, yi, vi, xj, yj, vj = a.x[i], a.y[i], a.speed[i], b.x[j], b.y[j], b.speed[j]
    d = np.sqrt((xi - xj) ** 2 + (yi - yj) ** 2)
    ahead = _agrees(yj - yi, xj - xi, a.vy[i], a.vx[i], 90.0) <= 90
    pick = lambda p, q: np.where(ahead, p, q)
    vl, vf, lf, hf = pick(vj, vi), pick(vi, vj), pick(a.length[i], b.length[j]), pick(a.heading[i], b.heading[j])
    xl, yl, xf, yf = pick(xj, xi), pick(yj, yi), pick(xi, xj), pick(yi, yj)
    gap = np.sqrt((xl - (xf + lf * np.cos(hf))) ** 2 + (yl - (yf + lf * np.sin(hf))) ** 2)
    closing = vf > vl
    thw = d / (vf + e2)
    ttc = np.where(both, np.where(closing, gap / (vf - vl), np.inf), np.nan)
    drac = np.where(both, np.where(closing & (d > 0), (vf - vl) * (vf - vl) / (2 * d), 0.0), np.nan)
    positive = lambda m: np.fmin.reduce(np.where(m > 0, m, np.nan), axis=1)
    hit = both & ((d <= within) | _meet(a, b, i, j))
    same = _agrees(b.vy[j], b.vx[j], a.vy[i], a.vx[i], angle) < angle
    out = {
        "i": a.ids[i], "j": b.ids[j], "n_common": both.sum(axis=1), "n_aligned": (both & same).sum(axis=1), "min_d": np.fmin.reduce(d, axis=1),
        "thw": np.fmin.reduce(thw, axis=1), "ttc": np.fmin.reduce(ttc, axis=1), "drac": np.fmax.reduce(drac, axis=1),
        "thw_pos": positive(thw), "ttc_pos": positive(ttc), "collisions": hit.sum(axis=1).astype(float),
    }
    if points is None:
        return out | {"mttcp": np.nan, "scene_mttcp": np.nan}
    t = np.arange(n)
    # crossings: for each step of i the first step of j within a metre
    p, ti, tj = [], [], []
    for at in range(0, len(i), PART // n + 1):
        k = slice(at, at + PART // n + 1)
        own, its = i[k], j[k]
        met = np.sqrt((a.x[own][:, :, None] - b.x[its][:, None]) ** 2 + (a.y[own][:, :, None] - b.y[its][:, None]) ** 2) <= 1.0
        q, s = np.nonzero(met.any(axis=2))
        p.append(q + at), ti.append(s), tj.append(met[q, s].argmax(axis=1))
    p, ti, tj = (np.concatenate(c) for c in (p, ti, tj))
    mttcp = np.full(len(i), np.nan)
    for at in range(0, len(p), PART):
        q, s, u = p[at : at + PART], ti[at : at + PART], tj[at : at + PART]
        cx, cy = xi[q, s][:, None], yi[q, s][:, None]
        time = [np.sqrt((cx - x[q]) ** 2 + (cy - y[q]) ** 2) / (v[q] + e1) for x, y, v in ((xi, yi, vi), (xj, yj, vj))]
        ends = np.abs(time[0] - time[1])
        ends[~both[q] | (t > np.minimum(s, u)[:, None])] = np.nan
        mttcp = np.fmin(mttcp, _least(ends, len(i), q))
    # conflict points that both come near
    cx, cy = points
    scene = np.full(len(i), np.nan)
    if len(cx):
        sides = []
        for m in (a, b) if a is not b else (a,):
            far, least, at = m.nearest(cx, cy)
            sides.append((far / (m.speed[:, None] + e1), least <= radius, at))
        (time_i, in_i, at_i), (time_j, in_j, at_j) = sides[0], sides[-1]
        p, c = np.nonzero(in_i[i] & in_j[j])
        for at in range(0, len(p), PART):
            q, s = p[at : at + PART], c[at : at + PART]
            ends = np.abs(time_i[i[q], s] - time_j[j[q], s])
            ends[t > np.minimum(at_i[i[q], s], at_j[j[q], s])[:, None]] = np.nan
            scene = np.fmin(scene, _least(ends, len(i), q))
    return out | {"mttcp": mttcp, "scene_mttcp": scene}


def pair_measures(
    moving: DataFrame, maps: DataFrame | None = None, points: DataFrame | None = None, other: DataFrame | None = None,
    within: float = 0.25, angle: float = 45.0, radius: float = 5.0, e1: float = 1e-3, e2: float = 1e-4,
) -> DataFrame:
    """(scenario_id, i, j, MEASURES) of pairs with a common valid step.

    Numbers of common steps and of those with headings within ``angle`` degrees; least distance, headway
    and time to collision (also the least above 0), greatest deceleration, steps of collision.  With
    ``points``: least difference of times to a crossing and to a conflict point.  Null where unknown.
    """
    whole = ("n_common", "n_aligned")
    schema = "scenario_id long, i long, j long, " + ", ".join(f"{m} {'long' if m in whole else 'double'}" for m in MEASURES)
    names = ["scenario_id", "i", "j", *MEASURES]
    two = other is not None
    steps = moving.withColumn("side", F.lit(0))
    if two:
        same = [*AGENT, "t", "x", "y", "valid", *_COLUMNS]
        steps = steps.select(*same, "side").unionByName(other.select(*same, F.lit(1).alias("side")))

    def block(rows: pd.DataFrame, near: pd.DataFrame | None = None) -> pd.DataFrame:
        out = []
        for scene, own in _scenes(rows):
            n = own["t"].max() + 1
            sides = [_Agents(own[own["side"] == s], n, ("x", "y", *_COLUMNS)) for s in ((0, 1) if two else (0,))]
            for s in sides:
                s.with_previous()
            a, b = sides[0], sides[-1]
            related = a.ids[:, None] != b.ids if two else a.ids[:, None] < b.ids
            with np.errstate(all="ignore"):
                found = _measured(a, b, related, None if near is None else _around(own, near, radius)[1:], within, angle, radius, e1, e2)
            if found:
                out.append(pd.DataFrame({"scenario_id": scene, **found}))
        found = pd.concat(out)[names] if out else pd.DataFrame(columns=names)
        return found.astype(object).where(found.notna(), None) if found.isna().any(axis=None) else found

    if points is None:
        here = blocks(steps.where("valid").select(*AGENT, "t", "x", "y", *_COLUMNS, "side"))
        return here.withColumn("part", F.pmod("scenario_id", F.lit(15))).groupBy("block", "part").applyInPandas(lambda rows: block(rows), schema)
    return with_maps(steps, maps, points, *_COLUMNS, "side").applyInPandas(lambda rows, near: block(rows, near), schema)
