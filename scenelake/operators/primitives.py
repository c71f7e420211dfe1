"""Motion primitives and clusters: runs, segments, cubic change points, centroids, silhouettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, round_
from scenelake.operators.kinematics import AGENT, steps

#: Tolerances that the change-point search tries, the grid of candidates and the least gap.
TOLERANCES = (1e-3, 0.1, 1.0, 2.0, 4.0, 8.0)
FIRST, STRIDE, GAP = 3, 4, 4


def state_runs(states: DataFrame, state: str) -> DataFrame:
    """Runs of equal ``state`` of consecutive rows: start, end (exclusive) and state."""
    w = Window.partitionBy(*AGENT).orderBy("t")
    of_state = Window.partitionBy(*AGENT, state).orderBy("t")
    marked = states.withColumn("g", F.row_number().over(w) - F.row_number().over(of_state))
    return marked.groupBy(*AGENT, state, "g").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).drop("g")


def segment_bounds(bounds: DataFrame) -> DataFrame:
    """Boundaries to segments [c_i, c_{i+1}); the last boundary ends the last segment, plus one."""
    w = Window.partitionBy(*AGENT).orderBy("c")
    both = bounds.withColumns({"end": F.lead("c").over(w), "after": F.lead("c", 2).over(w)}).where(F.col("end").isNotNull())
    return both.select(*AGENT, F.col("c").alias("start"), (F.col("end") + F.col("after").isNull().cast("int")).alias("end"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(key, k, dist) of each (key, x, y) by the centroids (k, cx, cy), a few rows."""
    table = centroids.agg(F.collect_list(F.struct("k", "cx", "cy")).alias("cs"))
    near = F.array_min(
        F.transform("cs", lambda c: F.struct(round_(dist(F.col("x"), F.col("y"), c["cx"], c["cy"]), 6).alias("dist"), c["k"].alias("k")))
    )
    return points.crossJoin(F.broadcast(table)).select(key, "x", "y", near.alias("n")).select(key, "x", "y", "n.k", "n.dist")


def lloyd(points: DataFrame, k: int, rounds: int, key: str) -> DataFrame:
    """Fixed rounds of Lloyd's algorithm from the first ``k`` points by key; coordinates in integers
    of 1e-2, so that sums don't depend on order."""
    first = points.orderBy(key).limit(k).select((F.row_number().over(Window.orderBy(key)) - 1).alias("k"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    centroids = first
    for _ in range(rounds):
        near = nearest_centroid(points, centroids, key)
        centroids = near.groupBy("k").agg(
            *((F.sum(F.round(F.col(c) * 100).cast("long")) / F.count("*") / 100.0).alias(f"c{c}") for c in "xy")
        )
    return nearest_centroid(points, centroids, key)


def nearest_in_group(points: DataFrame, centres: DataFrame, group: str) -> DataFrame:
    """``points`` with k and dist of the nearest centre of their group; ``centres`` (group, k, cx, cy) are
    few: groups times clusters."""
    table = centres.groupBy(group).agg(F.collect_list(F.struct("k", "cx", "cy")).alias("cs"))
    near = F.array_min(
        F.transform("cs", lambda c: F.struct(round_(dist(F.col("x"), F.col("y"), c["cx"], c["cy"]), 6).alias("dist"), c["k"].alias("k")))
    )
    return points.join(F.broadcast(table), group).withColumn("n", near).select("*", "n.k", "n.dist").drop("cs", "n")


def centres(named: DataFrame, group: str) -> DataFrame:
    """Mean places of clusters, by integer sums of hundredths."""
    return named.groupBy(group, "k").agg(
        *((F.sum(F.round(F.col(c) * 100).cast("long")) / F.count("*") / 100.0).alias(f"c{c}") for c in "xy")
    )


def lloyd_groups(points: DataFrame, group: str, k: int, rounds: int, order: list[str]) -> DataFrame:
    """Lloyd's rounds within every group at once, from its first ``k`` points in ``order``."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    at = points.withColumn("k", first - 1).where(F.col("k") < k).select(group, "k", F.col("x").alias("cx"), F.col("y").alias("cy"))
    for _ in range(rounds):
        at = centres(nearest_in_group(points, at, group), group)
    return nearest_in_group(points, at, group)


def _cubic_error(t: np.ndarray, xy: np.ndarray) -> float:
    """Greatest distance of points to their least-squares cubics."""
    if len(t) < 2:
        return 0.0
    degree = min(3, len(t) - 1)
    basis = np.vander((t - t[0]) / max(1.0, t[-1] - t[0]), degree + 1)
    fit, *_ = np.linalg.lstsq(basis, xy, rcond=None)
    return float(np.sqrt(((basis @ fit - xy) ** 2).sum(1)).max())


def change_points(t: np.ndarray, xy: np.ndarray, tolerance: float) -> list[int]:
    """Row numbers of boundaries: candidates on a fixed grid, dropped one by one where the spans on
    both sides fit one cubic within ``tolerance`` or are too close to the boundary before."""
    bounds = [0, *range(FIRST, len(t) - STRIDE, STRIDE), len(t) - 1]
    at = 1
    while at < len(bounds) - 1:
        a, b = bounds[at - 1], bounds[at + 1]
        if bounds[at] - a <= GAP - 1 or _cubic_error(t[a : b + 1], xy[a : b + 1]) < tolerance:
            del bounds[at]
        else:
            at += 1
    return bounds


def cubic_primitives(tracks: DataFrame) -> DataFrame:
    """(scenario_id, agent_id, start, end, prim_id, error): the tolerance with the least sum of
    error and number of boundaries decides.  One agent's track, 91 rows at most, is one group."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, xy = pdf["t"].to_numpy(float), pdf[["x", "y"]].to_numpy()
        found = []
        for tolerance in TOLERANCES:
            b = change_points(t, xy, tolerance)
            error = max((_cubic_error(t[i : j + 1], xy[i : j + 1]) for i, j in zip(b, b[1:])), default=0.0)
            found.append((len(b) + error, error, b))
        _, error, b = min(found, key=lambda f: f[0])
        ends = [int(t[j]) for j in b[1:]]
        if ends:
            ends[-1] += 1
        return pd.DataFrame(
            {
                "scenario_id": pdf["scenario_id"].iloc[0],
                "agent_id": pdf["agent_id"].iloc[0],
                "start": [int(t[i]) for i in b[:-1]],
                "end": ends,
                "prim_id": range(len(b) - 1),
                "error": error,
            }
        )

    schema = "scenario_id long, agent_id long, start int, end int, prim_id int, error double"
    return tracks.where("valid").select(*AGENT, "t", "x", "y").groupBy(*AGENT).applyInPandas(split, schema)


def align_2d(shapes: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """RMSD of centred shapes (keys, i, x, y) to a centred reference (i, rx, ry) after the best
    rotation, in closed form: the angle is atan2(sum of cross, sum of dot)."""
    w = Window.partitionBy(*keys)
    mid = shapes.withColumns({c: F.col(c) - F.avg(c).over(w) for c in "xy"})
    both = mid.join(reference, "i")
    x, y, rx, ry = (F.col(c) for c in ("x", "y", "rx", "ry"))
    s = both.groupBy(*keys).agg(
        F.sum(x * ry - y * rx).alias("cross"),
        F.sum(x * rx + y * ry).alias("dot"),
        F.sum(x * x + y * y + rx * rx + ry * ry).alias("squares"),
        F.count("*").alias("n"),
    )
    best = F.sqrt(F.col("cross") ** 2 + F.col("dot") ** 2)
    return s.select(
        *keys,
        F.atan2("cross", "dot").alias("angle"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - 2 * best) / F.col("n")).alias("rmsd"),
    )


def silhouette(labelled: DataFrame, key: str) -> DataFrame:
    """Mean distances to the own cluster and the nearest other one, and (b - a) / max(a, b), by
    per-cluster sums: a point meets each cluster's members once, clusters being bounded groups."""
    other = labelled.select(F.col(key).alias("o"), F.col("k").alias("ok"), F.col("x").alias("ox"), F.col("y").alias("oy"), "block")
    d = dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    per = labelled.join(other, "block").where(F.col(key) != F.col("o")).groupBy(key, "k", "ok").agg(F.avg(d).alias("m"))
    ab = per.groupBy(key).agg(
        F.min(F.when(F.col("ok") == F.col("k"), F.col("m"))).alias("a"), F.min(F.when(F.col("ok") != F.col("k"), F.col("m"))).alias("b")
    )
    return ab.where("a is not null and b is not null").withColumn("s", F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))


def valid_steps(tracks: DataFrame) -> DataFrame:
    """Tracks with the rank of each valid step and their number."""
    v = tracks.where("valid")
    return v.withColumns({"rn": F.row_number().over(steps()), "n": F.count("*").over(Window.partitionBy(*AGENT))})
