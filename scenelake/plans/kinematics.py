"""Registered queries over single agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import nms_radius, norm, rotate, round_
from scenelake.operators import kinematics as k
from scenelake.plans.helpers import r4, rounded, sql_backward, sql_gradient, sql_norm, sql_r4
from scenelake.sources import world
from scenelake.sources.world import SQL_TRACKS, SQL_TYPES

A = k.AGENT
_AW = "WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)"
SQL_MOVING = f"""
moving AS (SELECT *, sqrt(vx*vx + vy*vy) AS speed, atan2(vy, vx) AS heading FROM (
    SELECT *, {sql_backward('x', '(1/0.1::double)')} AS vx, {sql_backward('y', '(1/0.1::double)')} AS vy FROM tracks {_AW}))"""
SQL_KIN = f"""
_acc AS (SELECT *, {sql_gradient('vx')} AS acc_x, {sql_gradient('vy')} AS acc_y, {sql_gradient('heading')} AS gh FROM moving {_AW}),
kin AS (SELECT * EXCLUDE (gh), {sql_gradient('acc_x')} AS jerk_x, {sql_gradient('acc_y')} AS jerk_y,
    gh + pi() - 2*pi()*floor((gh + pi())/(2*pi())) - pi() AS yaw_rate FROM _acc {_AW})"""


def track_scan(spark: SparkSession, d: str) -> DataFrame:
    return world.tracks(spark, d)


def target_filter(spark: SparkSession, d: str) -> DataFrame:
    """Targets of an allowed type that are valid now, with scenes left empty dropped."""
    t = world.with_type(world.tracks(spark, d))
    return t.where((F.col("t") == world.NOW) & F.col("valid") & F.col("is_target") & (F.col("object_type") == "TYPE_VEHICLE")).select(*A, "x", "y", "object_type")


def type_onehot(spark: SparkSession, d: str) -> DataFrame:
    t = world.with_type(world.tracks(spark, d)).where(F.col("t") == world.NOW)
    flags = [(F.col("object_type") == f"TYPE_{n.upper()}").cast("int").alias(f"is_{n}") for n in ("vehicle", "pedestrian", "cyclist")]
    return t.select(*A, *flags, F.col("is_target").cast("int").alias("target"), (F.col("agent_id") % 10 == 0).cast("int").alias("ego"))


def velocity_first_extrapolated(spark: SparkSession, d: str) -> DataFrame:
    return k.velocity(world.tracks(spark, d)).select(*A, "t", r4("vx"), r4("vy"))


def speed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, least and greatest speed of each agent, and the first steps of the extremes."""
    m = k.with_motion(world.tracks(spark, d)).withColumn("speed", round_("speed", 4))
    return m.groupBy(*A).agg(
        r4("mean_speed", F.avg("speed")),
        F.min("speed").alias("min_speed"),
        F.max("speed").alias("max_speed"),
        F.min(F.struct("speed", "t"))["t"].alias("argmin_t"),
        (-F.max(F.struct("speed", -F.col("t")))["col2"]).alias("argmax_t"),
    )


def kinematics_gradient(spark: SparkSession, d: str) -> DataFrame:
    found = k.kinematics(world.tracks(spark, d))
    return found.select(*A, "t", *(r4(c) for c in ("speed", "acc_x", "acc_y", "jerk_x", "jerk_y", "yaw_rate")))


def acceleration_lag(spark: SparkSession, d: str) -> DataFrame:
    return k.acceleration(world.tracks(spark, d)).select(*A, "t", r4("ax"), r4("ay"))


def finite_difference_yaw(spark: SparkSession, d: str) -> DataFrame:
    m = k.with_motion(world.tracks(spark, d))
    rate = m.withColumn("rate", (F.col("heading") - F.lag("heading").over(k.steps())) / k.H)
    return rate.groupBy(*A).agg(r4("mean_rate", F.avg("rate")), r4("min_rate", F.min("rate")), r4("max_rate", F.max("rate")))


def sideslip(spark: SparkSession, d: str) -> DataFrame:
    m = k.velocity(world.tracks(spark, d)).withColumn("slip", -F.atan2(F.col("vy"), F.abs("vx")))
    return m.groupBy(*A).agg(r4("mean_slip", F.avg("slip")), r4("min_slip", F.min("slip")), r4("max_slip", F.max("slip")))


def waiting_periods(spark: SparkSession, d: str) -> DataFrame:
    found = k.waiting_periods(world.tracks(spark, d))
    return found.select(*A, "start", F.col("n").alias("n_steps"), r4("duration"), r4("x"), r4("y"))


def valid_span(spark: SparkSession, d: str) -> DataFrame:
    return k.valid_span(world.tracks(spark, d))


def last_valid_position(spark: SparkSession, d: str) -> DataFrame:
    return k.last_valid_position(world.tracks(spark, d))


def interpolate_extrapolate_linear(spark: SparkSession, d: str) -> DataFrame:
    return k.interpolate(world.tracks(spark, d)).select(*A, "t", r4("fx"), r4("fy"))


def agent_dims(spark: SparkSession, d: str) -> DataFrame:
    return rounded(k.agent_dims(world.with_type(world.tracks(spark, d))), "length", "width")


def detection_bands(spark: SparkSession, d: str) -> DataFrame:
    found = k.detections(k.kinematics(world.tracks(spark, d)))
    return found.groupBy(*A).agg(*(F.count_if(f"{n}_hit").alias(f"{n}_hits") for n in ("lon", "lat", "yaw", "slip")))


def hist_mask(spark: SparkSession, d: str) -> DataFrame:
    """Valid steps that stay when the last 30, 60 or 90 per cent of them are masked."""
    v = world.tracks(spark, d).where("valid")
    v = v.withColumns({"rn": F.row_number().over(k.steps()), "n": F.count("*").over(Window.partitionBy(*A))})
    rates = F.explode(F.array(*(F.lit(r) for r in (3, 6, 9)))).alias("tenths")
    kept = v.select(*A, "t", "rn", "n", rates).where(F.col("rn") * 10 <= F.col("n") * (10 - F.col("tenths")))
    return kept.groupBy(*A, "tenths").agg(F.count("*").alias("n_kept"), F.max("t").alias("last_t"))


def zscore(spark: SparkSession, d: str) -> DataFrame:
    s = k.with_motion(world.tracks(spark, d)).groupBy(*A).agg(F.max("speed").alias("top"), F.avg("speed").alias("mean"))
    return rounded(k.zscore(s, ["top", "mean"]), "top", "mean")


def grid_rarity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(k.grid_rarity(k.with_motion(world.tracks(spark, d))), "rarity")


def finite_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Population mean and deviation of finite yaw rates and speeds over the whole data set."""
    m = k.kinematics(world.tracks(spark, d))
    ok = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("speed", "yaw_rate")}
    return m.agg(*(r4(f"{n}_{c}", f(e)) for c, e in ok.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def viewport(spark: SparkSession, d: str) -> DataFrame:
    """Centre and greatest extent of each scene's valid positions."""
    t = world.tracks(spark, d).where("valid").groupBy("scenario_id")
    b = t.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    return b.select(
        "scenario_id",
        *(r4(f"c_{c}", (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2) for c in "xy"),
        r4("extent", F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y"))),
    )


def agent_centric(spark: SparkSession, d: str) -> DataFrame:
    """Positions of all agents in the frame of each target now: shifted, then rotated."""
    m = k.with_motion(world.with_type(world.tracks(spark, d)))
    frame = m.where((F.col("t") == world.NOW) & F.col("is_target") & F.col("valid")).select(
        "scenario_id", F.col("agent_id").alias("target_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("heading").alias("ch")
    )
    now = m.where("valid").select(*A, "t", "x", "y").join(frame, "scenario_id")
    x, y = rotate(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), -F.col("ch"))
    return now.select(*A, "target_id", "t", r4("x", x), r4("y", y))


def resample_101(spark: SparkSession, d: str) -> DataFrame:
    """Each agent's valid track at 101 points of normalised time, by linear interpolation."""
    v = world.tracks(spark, d).where("valid")
    all_ = Window.partitionBy(*A)
    seg = v.withColumns({"lo": F.min("t").over(all_), "hi": F.max("t").over(all_)}).withColumns(
        {"nt": F.lead("t").over(k.steps()), "nx": F.lead("x").over(k.steps()), "ny": F.lead("y").over(k.steps())}
    ).where("hi > lo")
    span = F.col("hi") - F.col("lo")
    at = F.explode(F.sequence(F.lit(0), F.lit(100))).alias("i")
    u = F.col("i") * span
    inside = (u >= (F.col("t") - F.col("lo")) * 100) & ((u < (F.col("nt") - F.col("lo")) * 100) | (F.col("nt").isNull() & (F.col("i") == 100)))
    f = F.coalesce((u - (F.col("t") - F.col("lo")) * 100) / ((F.col("nt") - F.col("t")) * 100), F.lit(0.0))
    return seg.select("*", at).where(inside).select(
        *A, "i", *((round_(F.col(c) + F.coalesce((F.col(f"n{c}") - F.col(c)) * f, F.lit(0.0)), 9) + 0.0).alias(c) for c in "xy")
    )


def nms_radius_by_agent(spark: SparkSession, d: str) -> DataFrame:
    t = world.tracks(spark, d).where("valid").groupBy(*A).agg(
        F.min(F.struct("t", "x", "y")).alias("a"), F.max(F.struct("t", "x", "y")).alias("b")
    )
    length = norm(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return t.select(*A, r4("radius", nms_radius(length)))


def total_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each scene with the number of targets of all scenes before it."""
    t = world.with_type(world.tracks(spark, d)).where("is_target")
    n = t.groupBy("scenario_id").agg(F.countDistinct("agent_id").alias("n_targets"))
    # one row per scene: blocks of scenes are summed first, so no task orders all of them
    n = n.withColumn("block", F.floor(F.col("scenario_id") / 1024))
    blocks = n.groupBy("block").agg(F.sum("n_targets").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("block").orderBy("scenario_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.join(base, "block").select(
        "scenario_id", "n_targets", (F.col("base") + F.coalesce(F.sum("n_targets").over(own), F.lit(0))).alias("offset")
    )


_S = f"WITH {SQL_TRACKS}"
_SM = f"WITH {SQL_TRACKS},{SQL_MOVING}"
_SK = f"WITH {SQL_TRACKS},{SQL_MOVING},{SQL_KIN}"
_ST = f"WITH {SQL_TRACKS},{SQL_TYPES}"
_km = {v: f"({v}/1.609344::double)" for v in (40, 50, 100)}
_mm = {v: f"({v}::double/(1.609344::double*1000))" for v in (2.0, 2.5, 3.0, 4.0, 4.5, 7.0)}

QUERIES = {
    "track_scan": (track_scan, f"{_S} SELECT * FROM tracks"),
    "target_filter": (target_filter, f"{_ST} SELECT scenario_id, agent_id, x, y, object_type FROM typed WHERE t=10 AND valid AND is_target AND object_type='TYPE_VEHICLE'"),
    "type_onehot": (type_onehot, f"""{_ST} SELECT scenario_id, agent_id, (object_type='TYPE_VEHICLE')::int AS is_vehicle,
        (object_type='TYPE_PEDESTRIAN')::int AS is_pedestrian, (object_type='TYPE_CYCLIST')::int AS is_cyclist,
        is_target::int AS target, (agent_id % 10 = 0)::int AS ego FROM typed WHERE t=10"""),
    "velocity_first_extrapolated": (velocity_first_extrapolated, f"{_SM} SELECT scenario_id, agent_id, t, {sql_r4('vx','vx')}, {sql_r4('vy','vy')} FROM moving"),
    "speed_summary": (speed_summary, f"""{_SM}, q AS (SELECT * REPLACE (round(speed,4) AS speed) FROM moving)
        SELECT scenario_id, agent_id, {sql_r4('avg(speed)','mean_speed')}, min(speed) AS min_speed, max(speed) AS max_speed,
        min({{'s': speed, 't': t}}).t AS argmin_t, -(max({{'s': speed, 't': -t}}).t) AS argmax_t FROM q GROUP BY 1,2"""),
    "kinematics_gradient": (kinematics_gradient, f"{_SK} SELECT scenario_id, agent_id, t, " + ", ".join(sql_r4(c, c) for c in ("speed", "acc_x", "acc_y", "jerk_x", "jerk_y", "yaw_rate")) + " FROM kin"),
    "acceleration_lag": (acceleration_lag, f"""{_SM} SELECT scenario_id, agent_id, t, {sql_r4(sql_backward('vx','(1/0.1::double)'),'ax')}, {sql_r4(sql_backward('vy','(1/0.1::double)'),'ay')} FROM moving {_AW}"""),
    "finite_difference_yaw": (finite_difference_yaw, f"""{_SM}, q AS (SELECT *, (heading - lag(heading) OVER w)/0.1::double AS rate FROM moving {_AW})
        SELECT scenario_id, agent_id, {sql_r4('avg(rate)','mean_rate')}, {sql_r4('min(rate)','min_rate')}, {sql_r4('max(rate)','max_rate')} FROM q GROUP BY 1,2"""),
    "sideslip": (sideslip, f"""{_SM}, q AS (SELECT *, -atan2(vy, abs(vx)) AS slip FROM moving)
        SELECT scenario_id, agent_id, {sql_r4('avg(slip)','mean_slip')}, {sql_r4('min(slip)','min_slip')}, {sql_r4('max(slip)','max_slip')} FROM q GROUP BY 1,2"""),
    "waiting_periods": (waiting_periods, f"""{_S}, s AS (SELECT *, {sql_norm('x - lead(x) OVER w','y - lead(y) OVER w')} AS step FROM tracks {_AW}),
        m AS (SELECT *, t - row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY t) AS g FROM s WHERE step < 0.5),
        r AS (SELECT scenario_id, agent_id, min(t) AS start, count(*) AS n_steps FROM m GROUP BY scenario_id, agent_id, g)
        SELECT r.*, {sql_r4('n_steps*0.1::double','duration')}, {sql_r4('x','x')}, {sql_r4('y','y')} FROM r JOIN tracks k ON k.scenario_id=r.scenario_id AND k.agent_id=r.agent_id AND k.t=r.start"""),
    "valid_span": (valid_span, f"{_S} SELECT scenario_id, agent_id, min(t) FILTER (valid) AS first_t, max(t) FILTER (valid) AS last_t, count(*) FILTER (valid) AS n_valid FROM tracks GROUP BY 1,2 HAVING count(*) FILTER (valid) >= 2"),
    "last_valid_position": (last_valid_position, f"""{_S} SELECT scenario_id, agent_id, arg_max(x, t) FILTER (valid AND t<=10) AS x, arg_max(y, t) FILTER (valid AND t<=10) AS y,
        max(t) FILTER (valid AND t>10) AS last_future_t FROM tracks GROUP BY 1,2"""),
    "interpolate_extrapolate_linear": (interpolate_extrapolate_linear, f"""{_SM}, q AS (SELECT *,
        max(CASE WHEN valid THEN t END) OVER (PARTITION BY scenario_id, agent_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS pt,
        min(CASE WHEN valid THEN t END) OVER (PARTITION BY scenario_id, agent_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM moving),
        j AS (SELECT q.*, p.x AS px, p.y AS py, p.vx AS pvx, p.vy AS pvy, n.x AS nx, n.y AS ny FROM q
          LEFT JOIN moving p ON p.scenario_id=q.scenario_id AND p.agent_id=q.agent_id AND p.t=q.pt
          LEFT JOIN moving n ON n.scenario_id=q.scenario_id AND n.agent_id=q.agent_id AND n.t=q.nt)
        SELECT scenario_id, agent_id, t, """ + ", ".join(sql_r4(f"CASE WHEN valid THEN {a} WHEN pt IS NULL THEN n{a} WHEN nt IS NULL THEN p{a} + pv{a}*0.1::double*(t-pt) ELSE p{a} + (n{a}-p{a})*((t-pt)::double/(nt-pt)::double) END", f"f{a}") for a in "xy") + " FROM j"),
    "agent_dims": (agent_dims, f"{_ST} SELECT scenario_id, agent_id, {sql_r4('avg(length) FILTER (valid)','length')}, {sql_r4('avg(width) FILTER (valid)','width')} FROM typed GROUP BY 1,2"),
    "detection_bands": (detection_bands, f"""{_SK} SELECT scenario_id, agent_id,
        count(*) FILTER (abs(acc_x) > CASE WHEN speed <= {_km[50]} THEN {_mm[4.0]} WHEN speed <= {_km[100]} THEN abs({_mm[4.0]} - {_mm[2.0]}*(speed-{_km[50]})/{_km[100]}) ELSE {_mm[2.0]} END) AS lon_hits,
        count(*) FILTER (abs(acc_y) > CASE WHEN speed <= {_km[40]} THEN {_mm[2.5]} + {_mm[4.5]}*(speed/{_km[40]}) WHEN speed <= {_km[50]} THEN {_mm[7.0]}
            WHEN speed <= {_km[100]} THEN {_mm[7.0]} - {_mm[4.0]}*((speed-{_km[50]})/{_km[50]}) ELSE {_mm[3.0]} END) AS lat_hits,
        count(*) FILTER (abs(yaw_rate) > CASE WHEN speed <= {_km[50]} THEN 50.0::double/180 ELSE 15.0::double/180 END) AS yaw_hits,
        count(*) FILTER (abs(atan2(vy, abs(vx))) > 0.1745::double) AS slip_hits FROM kin GROUP BY 1,2"""),
    "hist_mask": (hist_mask, f"""{_S}, v AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY scenario_id, agent_id) AS n FROM tracks WHERE valid {_AW}),
        r AS (SELECT v.*, tenths FROM v, (VALUES (3),(6),(9)) AS x(tenths))
        SELECT scenario_id, agent_id, tenths, count(*) AS n_kept, max(t) AS last_t FROM r WHERE rn*10 <= n*(10-tenths) GROUP BY 1,2,3"""),
    "zscore": (zscore, f"""{_SM}, s AS (SELECT scenario_id, agent_id, max(speed) AS a, avg(speed) AS b FROM moving GROUP BY 1,2)
        SELECT scenario_id, agent_id, {sql_r4('(a - (SELECT avg(a) FROM s))/(SELECT stddev_pop(a) FROM s)','top')}, {sql_r4('(b - (SELECT avg(b) FROM s))/(SELECT stddev_pop(b) FROM s)','mean')} FROM s"""),
    "grid_rarity": (grid_rarity, f"""{_SM}, c AS (SELECT scenario_id, agent_id, least(floor(speed/6.0::double),9) AS bv, floor((heading+3.141592653589793::double)/0.6283185307179586::double) AS bh, count(*) AS n FROM moving GROUP BY ALL)
        SELECT scenario_id, agent_id, CAST(sum(n) AS BIGINT) AS n_steps, count(*) AS n_cells, {sql_r4('sum(n)/sqrt(count(*)::double)/count(*)','rarity')} FROM c GROUP BY 1,2"""),
    "finite_mean_std": (finite_mean_std, f"""{_SK} SELECT {sql_r4('avg(speed)','mean_speed')}, {sql_r4('stddev_pop(speed)','std_speed')},
        {sql_r4('avg(yaw_rate)','mean_yaw_rate')}, {sql_r4('stddev_pop(yaw_rate)','std_yaw_rate')} FROM kin"""),
    "viewport": (viewport, f"""{_S} SELECT scenario_id, {sql_r4('(min(x)+max(x))/2','c_x')}, {sql_r4('(min(y)+max(y))/2','c_y')}, {sql_r4('greatest(max(x)-min(x), max(y)-min(y))','extent')} FROM tracks WHERE valid GROUP BY 1"""),
    "agent_centric": (agent_centric, f"""{_SM}, f AS (SELECT scenario_id, agent_id AS target_id, x AS cx, y AS cy, -heading AS a FROM moving WHERE t=10 AND valid AND agent_id % 10 <= 2)
        SELECT m.scenario_id, agent_id, target_id, t, {sql_r4('(x-cx)*cos(a)-(y-cy)*sin(a)','x')}, {sql_r4('(x-cx)*sin(a)+(y-cy)*cos(a)','y')} FROM moving m JOIN f USING (scenario_id) WHERE valid"""),
    "resample_101": (resample_101, f"""{_S}, v AS (SELECT *, min(t) OVER a AS lo, max(t) OVER a AS hi, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tracks WHERE valid
        WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t), a AS (PARTITION BY scenario_id, agent_id)),
        g AS (SELECT *, i*(hi-lo) AS u FROM v, (SELECT CAST(unnest(range(101)) AS INT) AS i) WHERE hi > lo),
        h AS (SELECT *, coalesce((u-(t-lo)*100)/((nt-t)*100)::double, 0) AS f FROM g WHERE u >= (t-lo)*100 AND (u < (nt-lo)*100 OR (nt IS NULL AND i=100)))
        SELECT scenario_id, agent_id, i, round(x + coalesce((nx-x)*f, 0), 9) + 0.0::double AS x, round(y + coalesce((ny-y)*f, 0), 9) + 0.0::double AS y FROM h"""),
    "nms_radius": (nms_radius_by_agent, f"""{_S}, e AS (SELECT scenario_id, agent_id, {sql_norm('arg_max(x,t)-arg_min(x,t)','arg_max(y,t)-arg_min(y,t)')} AS l FROM tracks WHERE valid GROUP BY 1,2)
        SELECT scenario_id, agent_id, {sql_r4('least(3.5::double, greatest(2.5::double, (l-10)/40*1.5::double + 2.5::double))','radius')} FROM e"""),
    "total_tracks": (total_tracks, f"""{_ST}, n AS (SELECT scenario_id, count(DISTINCT agent_id) AS n_targets FROM typed WHERE is_target GROUP BY 1)
        SELECT *, CAST(coalesce(sum(n_targets) OVER (ORDER BY scenario_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n"""),
}
