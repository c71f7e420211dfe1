"""Shapes of tracks inside Spark: distance matrices in closed form, and grouped curve operators.

A group is a scene, whose agents the domain bounds.  What has a closed form stays in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.operators.kinematics import AGENT, steps
from scenelake.operators.pairs import PAIR, _side

Curves = dict[int, tuple[np.ndarray, np.ndarray]]


def per_scene(tracks: DataFrame, rows: Callable[[int, Curves], Iterator[tuple]], schema: str, least: int = 6) -> DataFrame:
    """What ``rows`` yields for each scene from its agents' (times, points), by id; agents with fewer than
    ``least`` valid steps are left out.  ``schema`` names the columns behind scenario_id."""
    full = f"scenario_id long, {schema}"
    names = [c.split()[0] for c in full.split(", ")]

    def scene(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["agent_id", "t"])
        curves = {}
        for agent, own in pdf.groupby("agent_id"):
            if len(own) >= least:
                curves[int(agent)] = (own["t"].to_numpy(float), own[["x", "y"]].to_numpy())
        at = int(pdf["scenario_id"].iloc[0])
        return pd.DataFrame([(at, *r) for r in rows(at, curves)], columns=names)

    return tracks.where("valid").select(*AGENT, "t", "x", "y").groupBy("scenario_id").applyInPandas(scene, full)


def distance_matrix(curves: list[np.ndarray], distance: Callable[[np.ndarray, np.ndarray], float]) -> np.ndarray:
    d = np.zeros((len(curves), len(curves)))
    for i in range(len(curves)):
        for j in range(i):
            d[i, j] = d[j, i] = round(distance(curves[i], curves[j]), 9)
    return d


def shape_sums(tracks: DataFrame) -> DataFrame:
    """Per pair i < j over common valid steps: n, the sums of products that every best rotation needs, and
    the mean difference of step lengths."""
    w = steps()
    v = tracks.where("valid").withColumns({"sx": F.col("x") - F.lag("x").over(w), "sy": F.col("y") - F.lag("y").over(w), "t_": F.col("t")})
    columns = ["t_", "x", "y", "sx", "sy"]
    a, b = _side(v, "i", columns).withColumnRenamed("t__i", "t"), _side(v, "j", columns).withColumnRenamed("t__j", "t")
    both = a.join(b, ["scenario_id", "t"]).where("i < j")
    xi, yi, xj, yj = (F.col(c) for c in ("x_i", "y_i", "x_j", "y_j"))
    speed = F.abs(F.sqrt(F.col("sx_i") ** 2 + F.col("sy_i") ** 2) - F.sqrt(F.col("sx_j") ** 2 + F.col("sy_j") ** 2))
    return both.groupBy(*PAIR).agg(
        F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in {
            "mxi": xi, "myi": yi, "mxj": xj, "myj": yj, "xx": xi * xj, "yy": yi * yj, "xy": xi * yj, "yx": yi * xj,
            "qi": xi * xi + yi * yi, "qj": xj * xj + yj * yj,
        }.items()), F.avg(speed).alias("speed"),
    )


def procrustes_distances(sums: DataFrame) -> DataFrame:
    """(pair, rotated, reflected, speed): distances of unit curves after the best rotation, and after the
    best rotation or reflection, from :func:`shape_sums`; null where a curve is one place."""
    n = F.col("n")
    mid = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / n
    xx, yy, xy, yx = mid("xx", "mxi", "mxj"), mid("yy", "myi", "myj"), mid("xy", "mxi", "myj"), mid("yx", "myi", "mxj")
    size = F.sqrt(
        (F.col("qi") - (F.col("mxi") ** 2 + F.col("myi") ** 2) / n) * (F.col("qj") - (F.col("mxj") ** 2 + F.col("myj") ** 2) / n)
    )
    turned = F.sqrt((xx + yy) ** 2 + (xy - yx) ** 2)
    mirrored = F.sqrt((xx - yy) ** 2 + (xy + yx) ** 2)

    def distance(best: Column) -> Column:
        return F.when(size > 1e-6, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * best / size)))

    return sums.select(*PAIR, "n", distance(turned).alias("rotated"), distance(F.greatest(turned, mirrored)).alias("reflected"), "speed")


def relative_motion(both: DataFrame, within: float = 100.0) -> DataFrame:
    """(pair, t, share, rx, ry) of rows of ``aligned``: j as seen from i where they are less than
    ``within`` apart, time from 0 to 1, turned so that the first bearing is the x axis."""
    near = both.where(F.col("d") < within).dropDuplicates([*PAIR, "t"])
    w = Window.partitionBy(*PAIR)
    first = F.min(F.struct("t", (F.col("x_j") - F.col("x_i")).alias("dx"), (F.col("y_j") - F.col("y_i")).alias("dy"))).over(w)
    rows = near.withColumns({"f": first, "a": F.min("t").over(w), "b": F.max("t").over(w)})
    turn = F.atan2(F.col("f.dy"), F.col("f.dx"))
    dx, dy = F.col("x_j") - F.col("x_i"), F.col("y_j") - F.col("y_i")
    share = F.coalesce(F.try_divide((F.col("t") - F.col("a")).cast("double"), (F.col("b") - F.col("a")).cast("double")), F.lit(0.0))
    return rows.select(
        *PAIR, "t", share.alias("share"), (dx * F.cos(turn) + dy * F.sin(turn)).alias("rx"), (dy * F.cos(turn) - dx * F.sin(turn)).alias("ry")
    )


def relabelled(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """``rank`` of each cluster by falling size; ``sizes`` has a row for each cluster of a model."""
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(n), key)) - 1)


def mismatches(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, cost): rows that are in one of two clusters but not in both, for all pairs of clusters.

    Counted once; the pairs are those of two models' clusters, not of rows."""
    both = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    na, nb = (both.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in (a, b))
    every = na.crossJoin(F.broadcast(nb)).join(both, [a, b], "left")  # clusters by clusters
    return every.select(a, b, (F.col(f"n_{a}") + F.col(f"n_{b}") - 2 * F.coalesce("n", F.lit(0))).alias("cost"))


def scatter(points: DataFrame, group: list[str], columns: list[str]) -> Column:
    """Sum of squared distances to the group's mean, as an aggregate of one pass."""
    return sum(
        (F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count("*") for c in columns[1:]),
        F.sum(F.col(columns[0]) * F.col(columns[0])) - F.sum(columns[0]) * F.sum(columns[0]) / F.count("*"),
    )
