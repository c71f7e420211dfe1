"""Per-agent operators over ordered tracks: windows by (scenario, agent) in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scenelake.functions.geometry import arctan2, backward, dist, gradient, norm, wrap

AGENT = ["scenario_id", "agent_id"]
H = 0.1


def steps() -> WindowSpec:
    """An agent's rows in time order."""
    return Window.partitionBy(*AGENT).orderBy("t")


def velocity(tracks: DataFrame) -> DataFrame:
    """vx, vy in m/s; the first step repeats the second's."""
    return tracks.withColumns({"vx": backward(F.col("x"), steps(), 1 / H), "vy": backward(F.col("y"), steps(), 1 / H)})


def with_motion(tracks: DataFrame) -> DataFrame:
    """velocity plus speed and heading (radians)."""
    moving = velocity(tracks)
    return moving.withColumns({"speed": norm(F.col("vx"), F.col("vy")), "heading": F.atan2("vy", "vx")})


def kinematics(tracks: DataFrame) -> DataFrame:
    """with_motion plus acceleration and jerk per axis and the wrapped yaw rate, by gradients."""
    # a yaw rate on the edge between -pi and pi depends on the last bit of two headings
    moving = with_motion(tracks).withColumn("heading", arctan2(F.col("vy"), F.col("vx")))
    acc = moving.withColumns({f"acc_{a}": gradient(F.col(f"v{a}"), steps(), H) for a in "xy"})
    return acc.withColumns(
        {f"jerk_{a}": gradient(F.col(f"acc_{a}"), steps(), H) for a in "xy"}
        | {"yaw_rate": wrap(gradient(F.col("heading"), steps(), H))}
    )


def acceleration(tracks: DataFrame) -> DataFrame:
    """ax, ay by backward differences of velocity; the first step repeats the second's."""
    moving = velocity(tracks)
    return moving.withColumns({f"a{a}": backward(F.col(f"v{a}"), steps(), 1 / H) for a in "xy"})


def runs(df: DataFrame, flag: Column, keys: list[str] = AGENT, order: str = "t") -> DataFrame:
    """Islands of consecutive rows where ``flag`` holds: keys, start, end (inclusive), n."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.where(flag).withColumn("_g", F.col(order) - F.row_number().over(w))
    return (
        marked.groupBy(*keys, "_g")
        .agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
        .drop("_g")
    )


def waiting_periods(tracks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Runs of steps shorter than ``threshold`` metres, with duration and first position."""
    step = dist(F.col("x"), F.col("y"), F.lead("x").over(steps()), F.lead("y").over(steps()))
    found = runs(tracks.withColumn("step", step), F.col("step") < threshold)
    first = tracks.select(*AGENT, F.col("t").alias("start"), "x", "y")
    return found.join(first, [*AGENT, "start"]).withColumn("duration", F.col("n") * H)


def valid_span(tracks: DataFrame, least: int = 2) -> DataFrame:
    """First and last valid step, and their number, of agents with ``least`` valid steps."""
    valid = F.col("valid")
    return (
        tracks.groupBy(*AGENT)
        .agg(
            F.min(F.when(valid, F.col("t"))).alias("first_t"),
            F.max(F.when(valid, F.col("t"))).alias("last_t"),
            F.count_if(valid).alias("n_valid"),
        )
        .where(F.col("n_valid") >= least)
    )


def last_valid_position(tracks: DataFrame, now: int = 10) -> DataFrame:
    """Last valid position up to ``now``, and the last valid step after it."""
    at = F.when(F.col("valid") & (F.col("t") <= now), F.struct("t", "x", "y"))
    return tracks.groupBy(*AGENT).agg(
        F.max(at).alias("p"), F.max(F.when(F.col("valid") & (F.col("t") > now), F.col("t"))).alias("last_future_t")
    ).select(*AGENT, F.col("p.x").alias("x"), F.col("p.y").alias("y"), "last_future_t")


def interpolate(tracks: DataFrame) -> DataFrame:
    """fx, fy at every step: linear inside gaps, constant velocity after the last valid step
    (by the last reported velocity), the first valid position before it."""
    moving = velocity(tracks)
    known = F.when(F.col("valid"), F.struct("t", "x", "y", "vx", "vy"))
    past = steps().rowsBetween(Window.unboundedPreceding, 0)
    future = steps().rowsBetween(0, Window.unboundedFollowing)
    both = moving.withColumns(
        {"_p": F.last(known, ignorenulls=True).over(past), "_n": F.first(known, ignorenulls=True).over(future)}
    )

    def filled(axis: str) -> Column:
        p, n = F.col(f"_p.{axis}"), F.col(f"_n.{axis}")
        share = F.try_divide((F.col("t") - F.col("_p.t")).cast("double"), (F.col("_n.t") - F.col("_p.t")).cast("double"))
        return (
            F.when(F.col("valid"), F.col(axis))
            .when(F.col("_p").isNull(), n)
            .when(F.col("_n").isNull(), p + F.col(f"_p.v{axis}") * H * (F.col("t") - F.col("_p.t")))
            .otherwise(p + (n - p) * share)
        )

    return both.withColumns({"fx": filled("x"), "fy": filled("y")}).drop("_p", "_n")


def agent_dims(tracks: DataFrame) -> DataFrame:
    """Mean length and width over valid steps."""
    return tracks.groupBy(*AGENT).agg(
        *(F.avg(F.when(F.col("valid"), F.col(c))).alias(c) for c in ("length", "width"))
    )


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores; constant columns give 0, unknown values none.  One aggregate, no global window."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns(
        {c: F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    ).drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def detections(moving: DataFrame) -> DataFrame:
    """Threshold detections by speed band: longitudinal and lateral acceleration, yaw rate, sideslip."""
    mile = 1.609344
    km = {v: v / mile for v in (40.0, 50.0, 100.0)}
    m = {v: v / (mile * 1000) for v in (2.0, 2.5, 3.0, 4.0, 4.5, 7.0)}
    v, lon, lat = F.col("speed"), F.abs("acc_x"), F.abs("acc_y")
    lon_limit = (
        F.when(v <= km[50.0], m[4.0])
        .when(v <= km[100.0], F.abs(m[4.0] - m[2.0] * (v - km[50.0]) / km[100.0]))
        .otherwise(m[2.0])
    )
    lat_limit = (
        F.when(v <= km[40.0], m[2.5] + m[4.5] * (v / km[40.0]))
        .when(v <= km[50.0], m[7.0])
        .when(v <= km[100.0], m[7.0] - m[4.0] * ((v - km[50.0]) / km[50.0]))
        .otherwise(m[3.0])
    )
    yaw_limit = F.when(v <= km[50.0], 50.0 / 180.0).otherwise(15.0 / 180.0)
    return moving.withColumns(
        {
            "lon_hit": lon > lon_limit,
            "lat_hit": lat > lat_limit,
            "yaw_hit": F.abs("yaw_rate") > yaw_limit,
            "slip_hit": F.abs(F.atan2(F.col("vy"), F.abs("vx"))) > 0.1745,
        }
    )


def grid_rarity(moving: DataFrame, bins: int = 10, top: float = 60.0) -> DataFrame:
    """C = (1/M)(N/sqrt(M)) of each agent: N steps of it in M different cells of a speed-by-heading grid."""
    cell = moving.withColumns(
        {
            "bv": F.least(F.floor(F.col("speed") / (top / bins)), F.lit(bins - 1)),
            "bh": F.floor((F.col("heading") + 3.141592653589793) / 0.6283185307179586),
        }
    )
    per = cell.groupBy(*AGENT, "bv", "bh").agg(F.count("*").alias("n"))
    return per.groupBy(*AGENT).agg(
        F.sum("n").alias("n_steps"),
        F.count("*").alias("n_cells"),
        (F.sum("n") / F.sqrt(F.count("*").cast("double")) / F.count("*")).alias("rarity"),
    )
