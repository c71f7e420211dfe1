"""Operators over pairs of agents: joins by scenario (and step), gates, interaction measures.

All joins have the scenario as equality key; conditions on distance are residual.  Gates are
aggregates that are semi-joined before anything expensive is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, heading_difference, inverse, segments_meet
from scenelake.operators.kinematics import AGENT, steps
from scenelake.operators.scenes import nearest_to_points, pair_measures

PAIR = ["scenario_id", "i", "j"]
STATUS = ("no_overlap", "stationary", "too_far", "heading", "ok")


def _side(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return df.select("scenario_id", F.col("agent_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))


def agents(tracks: DataFrame) -> DataFrame:
    return tracks.select(*AGENT).distinct()


def unordered(tracks: DataFrame) -> DataFrame:
    """(scenario_id, i, j), i < j."""
    a = agents(tracks)
    return _side(a, "i", []).join(_side(a, "j", []), "scenario_id").where("i < j")


def ordered(tracks: DataFrame) -> DataFrame:
    """(scenario_id, i, j), i <> j."""
    a = agents(tracks)
    return _side(a, "i", []).join(_side(a, "j", []), "scenario_id").where("i <> j")


def aligned(tracks: DataFrame, columns: list[str] | None = None, other: DataFrame | None = None) -> DataFrame:
    """Pairs i < j at every step where both are valid, with ``columns`` of both and the distance.

    With ``other``, i is of ``tracks`` and j of ``other``, and a pair comes in both orders.
    """
    columns = ["x", "y", *(columns or [])]

    def steps_of(df: DataFrame, name: str) -> DataFrame:
        side = _side(df.where("valid").withColumn("t_", F.col("t")), name, ["t_", *columns])
        return side.withColumnRenamed(f"t__{name}", "t")

    both = steps_of(tracks, "i").join(steps_of(tracks if other is None else other, "j"), ["scenario_id", "t"])
    both = both.where(_related(other))
    return both.withColumn("d", dist(F.col("x_i"), F.col("y_i"), F.col("x_j"), F.col("y_j")))


def _related(other: DataFrame | None) -> Column:
    return F.col("i") < F.col("j") if other is None else F.col("i") != F.col("j")


def encounters(tracks: DataFrame, within: float = 100.0) -> DataFrame:
    """Pairs that never part by ``within`` metres or more, with their common span."""
    return (
        aligned(tracks)
        .groupBy(*PAIR)
        .agg(F.max("d").alias("max_d"), F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
        .where(F.col("max_d") < within)
    )


def distance_trend(tracks: DataFrame) -> DataFrame:
    """Slope of the distance over time, and whether the pair parts."""
    slope = aligned(tracks).groupBy(*PAIR).agg(F.regr_slope("d", F.col("t").cast("double")).alias("slope"))
    return slope.where("slope is not null").withColumn("increasing", F.col("slope") > 0)


def status(
    moving: DataFrame, still: float = 0.25, near: float = 50.0, angle: float = 45.0, least: int = 2
) -> DataFrame:
    """Why a pair is or isn't measured: the first gate that it fails, in order.

    Gates: a common valid step; one of the two moves (mean speed above ``still``); some distance
    below ``near``; ``least`` steps with headings within ``angle`` degrees.
    """
    whole = moving if "length" in moving.columns else moving.withColumn("length", F.lit(0.0))
    met = pair_measures(whole, angle=angle).select(*PAIR, "min_d", "n_aligned", "n_common")
    mean = moving.groupBy(*AGENT).agg(F.avg("speed").alias("v"))
    pairs = unordered(moving).join(_side(mean, "i", ["v"]), ["scenario_id", "i"]).join(_side(mean, "j", ["v"]), ["scenario_id", "j"])
    gate = (
        F.when(F.col("n_common").isNull(), STATUS[0])
        .when((F.col("v_i") <= still) & (F.col("v_j") <= still), STATUS[1])
        .when(F.col("min_d") >= near, STATUS[2])
        .when(F.col("n_aligned") < least, STATUS[3])
        .otherwise(STATUS[4])
    )
    return pairs.join(met, PAIR, "left").select(*PAIR, gate.alias("status"), "min_d", "n_aligned")


def with_previous(tracks: DataFrame) -> DataFrame:
    """Valid steps with the valid position before."""
    w = steps()
    return tracks.where("valid").withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})


def _hit(within: float) -> Column:
    meet = segments_meet(*(F.col(c) for c in ("px_i", "py_i", "x_i", "y_i", "px_j", "py_j", "x_j", "y_j")))
    return (F.col("d") <= within) | F.coalesce(meet, F.lit(False))


def collisions(tracks: DataFrame, within: float = 0.25) -> DataFrame:
    """Steps at which two agents come within ``within`` metres or their last segments meet."""
    both = aligned(with_previous(tracks), ["px", "py"])
    return both.where(_hit(within)).groupBy(*PAIR).agg(F.count("*").alias("n_hits"), F.min("t").alias("first_t"))


def crossings(tracks: DataFrame, within: float = 1.0, other: DataFrame | None = None) -> DataFrame:
    """(scenario_id, i, j, ti, tj): for each step of i, the first step of j within ``within`` metres.

    A grid of cells as wide as the radius turns the distance into an equality key: i's cell and its
    neighbours are joined to j's cell, so agents that never come near make no rows.
    """
    v = tracks.where("valid")
    cell = [F.floor(F.col(c) / within).alias(f"c{c}") for c in "xy"]
    right = (v if other is None else other.where("valid")).select("scenario_id", F.col("agent_id").alias("j"), F.col("t").alias("tj"), F.col("x").alias("xj"), F.col("y").alias("yj"), *cell)
    around = neighbours().alias("o")
    left = v.select("scenario_id", F.col("agent_id").alias("i"), F.col("t").alias("ti"), F.col("x").alias("xi"), F.col("y").alias("yi"), *cell, around)
    left = left.withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b")}).drop("o")
    near = left.join(right, ["scenario_id", "cx", "cy"]).where(
        _related(other) & (dist(F.col("xi"), F.col("yi"), F.col("xj"), F.col("yj")) <= within)
    )
    return near.groupBy(*PAIR, "ti").agg(F.min("tj").alias("tj"), F.first("xi").alias("cx"), F.first("yi").alias("cy"))


def _ahead() -> Column:
    """j leads i if it is within 90 degrees of i's heading."""
    bearing = F.degrees(F.atan2(F.col("y_j") - F.col("y_i"), F.col("x_j") - F.col("x_i")))
    return heading_difference(F.degrees("heading_i"), bearing) <= 90


def leads(moving: DataFrame) -> DataFrame:
    """aligned() with heading, length, speed and who leads."""
    return aligned(moving, ["heading", "speed", "length"]).withColumn("j_leads", _ahead())


def _measures(e2: float = 1e-4) -> dict[str, Column]:
    """THW, TTC and DRAC of a row of leads(); infinity and 0 where undefined."""

    def of(name: str, leader: bool) -> Column:
        a, b = ("j", "i") if leader else ("i", "j")
        return F.when(F.col("j_leads"), F.col(f"{name}_{a}")).otherwise(F.col(f"{name}_{b}"))

    vl, vf, lf, hf = of("speed", True), of("speed", False), of("length", False), of("heading", False)
    xl, yl, xf, yf = of("x", True), of("y", True), of("x", False), of("y", False)
    gap = dist(xl, yl, xf + lf * F.cos(hf), yf + lf * F.sin(hf))
    closing, inf = vf > vl, F.lit(float("inf"))
    return {
        "thw": F.col("d") / (vf + e2),
        "ttc": F.when(closing, F.try_divide(gap, vf - vl)).otherwise(inf),
        "drac": F.when(closing & (F.col("d") > 0), F.try_divide((vf - vl) * (vf - vl), 2 * F.col("d"))).otherwise(0.0),
    }


def following(moving: DataFrame, e2: float = 1e-4) -> DataFrame:
    """THW, TTC and DRAC of every common step of a pair."""
    return leads(moving).select(*PAIR, "t", *(c.alias(n) for n, c in _measures(e2).items()))


def agent_mttcp(moving: DataFrame, e1: float = 1e-3, other: DataFrame | None = None) -> DataFrame:
    """Least difference of the two times to a crossing, over the steps before either reaches it."""
    cross = crossings(moving, other=other)
    v = moving.where("valid")
    u = v if other is None else other.where("valid")
    left = v.select("scenario_id", F.col("agent_id").alias("i"), "t", F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("speed").alias("vi"))
    right = u.select("scenario_id", F.col("agent_id").alias("j"), "t", F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("speed").alias("vj"))
    rows = cross.join(left, ["scenario_id", "i"]).where(F.col("t") <= F.least("ti", "tj")).join(right, ["scenario_id", "j", "t"])
    gap = F.abs(
        dist(F.col("cx"), F.col("cy"), F.col("xi"), F.col("yi")) / (F.col("vi") + e1)
        - dist(F.col("cx"), F.col("cy"), F.col("xj"), F.col("yj")) / (F.col("vj") + e1)
    )
    return rows.groupBy(*PAIR).agg(F.min(gap).alias("mttcp"), F.countDistinct("ti").alias("n_crossings"))


def neighbours() -> Column:
    """A grid cell and its eight neighbours, as a row each of steps (a, b)."""
    steps_ = (F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))
    return F.explode(F.array(*steps_))


def scene_mttcp(
    moving: DataFrame, maps: DataFrame, points: DataFrame, radius: float = 5.0, e1: float = 1e-3, other: DataFrame | None = None
) -> DataFrame:
    """Least difference of times to conflict points that both agents come within ``radius`` of.

    Steps count up to the smaller of the two first steps of least distance.
    """

    def side(df: DataFrame, n: str) -> DataFrame:
        near = nearest_to_points(df, maps, points, radius)
        return near.select("scenario_id", "cp_id", "cx", "cy", F.col("agent_id").alias(n), F.col("t").alias(f"at_{n}"))

    def steps_of(df: DataFrame, n: str) -> DataFrame:
        own = df.where("valid")
        return own.select("scenario_id", F.col("agent_id").alias(n), "t", *(F.col(c).alias(f"{c}_{n}") for c in ("x", "y", "speed")))

    right = moving if other is None else other
    pairs = side(moving, "i").join(side(right, "j").drop("cx", "cy"), ["scenario_id", "cp_id"]).where(_related(other))
    rows = pairs.join(steps_of(moving, "i"), ["scenario_id", "i"]).where(F.col("t") <= F.least("at_i", "at_j"))
    rows = rows.join(steps_of(right, "j"), ["scenario_id", "j", "t"])

    def time(n: str) -> Column:
        return dist(F.col(f"x_{n}"), F.col(f"y_{n}"), F.col("cx"), F.col("cy")) / (F.col(f"speed_{n}") + e1)

    gap = F.min(F.abs(time("i") - time("j")))
    return rows.groupBy(*PAIR).agg(gap.alias("mttcp"), F.countDistinct("cp_id").alias("n_points"))


#: What interaction_features() gives for a pair.
FEATURES = ("thw", "ttc", "drac", "mttcp", "scene_mttcp", "collisions")


def interaction_features(
    moving: DataFrame, maps: DataFrame, points: DataFrame, other: DataFrame | None = None, within: float = 0.25
) -> DataFrame:
    """Per pair: 1/min of THW, TTC and both mTTCP (0 if never), greatest DRAC, number of collision
    steps, and the least distance."""
    every = pair_measures(moving, maps, points, other, within)

    def feature(c: str) -> Column:
        return F.coalesce(inverse(F.col(c)), F.lit(0.0)).alias(c)

    return every.select(*PAIR, *(F.col(c) if c in ("drac", "collisions") else feature(c) for c in FEATURES), "min_d")


def both_sides(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair as two rows: agent_id, other and the columns."""
    sides = F.explode(F.array(*(F.struct(F.col(a).alias("agent_id"), F.col(b).alias("other")) for a, b in (("i", "j"), ("j", "i")))))
    return pairs.select("scenario_id", sides.alias("s"), *columns).select("scenario_id", "s.agent_id", "s.other", *columns)


def min_distance_to_targets(tracks: DataFrame, targets: DataFrame) -> DataFrame:
    """Least distance of each agent to any target, over jointly valid steps; targets have 0.

    ``targets``: (scenario_id, agent_id).
    """
    near = aligned(tracks).groupBy(*PAIR).agg(F.min("d").alias("d"))
    t = targets.select("scenario_id", F.col("agent_id").alias("other"))
    least = both_sides(near, "d").join(t, ["scenario_id", "other"], "left_semi").groupBy(*AGENT).agg(F.min("d").alias("d"))
    mine = agents(tracks).join(targets.select(*AGENT, F.lit(True).alias("_t")), AGENT, "left").join(least, AGENT, "left")
    return mine.select(*AGENT, F.when(F.col("_t"), 0.0).otherwise(F.col("d")).alias("d"))


def proximity_pooling(moving: DataFrame, scale: float = 1.2) -> DataFrame:
    """Neighbours' mean speed, weighted by exp(-least distance / scale)."""
    both = both_sides(aligned(moving).groupBy(*PAIR).agg(F.min("d").alias("d")), "d")
    mean = moving.groupBy(*AGENT).agg(F.avg("speed").alias("v")).select("scenario_id", F.col("agent_id").alias("other"), "v")
    weighted = both.join(mean, ["scenario_id", "other"]).withColumn("w", F.exp(-F.col("d") / scale))
    return weighted.groupBy(*AGENT).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("pooled"))
