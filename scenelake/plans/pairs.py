"""Registered queries over pairs of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators import kinematics as k
from scenelake.operators import pairs as p
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.plans.kinematics import SQL_MOVING
from scenelake.sources import world
from scenelake.sources.world import SQL_POINTS, SQL_TRACKS


def _moving(spark: SparkSession, d: str) -> DataFrame:
    return world.with_type(k.with_motion(world.tracks(spark, d)))


def conflict_points(spark: SparkSession, d: str) -> DataFrame:
    """(map_id, cp_id, cx, cy): the first point of every lane of a map."""
    first = world.lane_points(spark, d).where("pt = 0").select("lane_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return world.lanes(spark, d).select("map_id", "lane_id").join(first, "lane_id").select("map_id", F.col("lane_id").alias("cp_id"), "cx", "cy")


def pair_unordered(spark: SparkSession, d: str) -> DataFrame:
    return p.unordered(world.tracks(spark, d))


def pair_ordered_asym(spark: SparkSession, d: str) -> DataFrame:
    return p.ordered(world.tracks(spark, d))


def pair_time_aligned(spark: SparkSession, d: str) -> DataFrame:
    return p.aligned(world.tracks(spark, d)).groupBy(*p.PAIR).agg(
        F.count("*").alias("n_common"), r4("min_d", F.min("d")), r4("mean_d", F.avg("d"))
    )


def encounters_within_100m(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.encounters(world.tracks(spark, d)), "max_d")


def distance_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.distance_trend(world.tracks(spark, d)), "slope").drop("increasing")


def pair_status_cascade(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.status(_moving(spark, d)), "min_d").drop("n_aligned")


def collisions_sync(spark: SparkSession, d: str) -> DataFrame:
    return p.collisions(world.tracks(spark, d))


def trajectory_crossing(spark: SparkSession, d: str) -> DataFrame:
    return p.crossings(world.tracks(spark, d)).select(*p.PAIR, "ti", "tj")


def thw_ttc_drac(spark: SparkSession, d: str) -> DataFrame:
    f = p.pair_measures(_moving(spark, d))
    return f.select(*p.PAIR, r4("min_thw", F.col("thw")), r4("min_ttc", F.least(F.col("ttc"), F.lit(1e6))), r4("max_drac", F.least(F.col("drac"), F.lit(1e6))))


def agent_mttcp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.agent_mttcp(_moving(spark, d)), "mttcp")


def scene_mttcp(spark: SparkSession, d: str) -> DataFrame:
    t = _moving(spark, d)
    return rounded(p.scene_mttcp(t, world.scene_maps(t), conflict_points(spark, d)), "mttcp")


def features(spark: SparkSession, d: str) -> DataFrame:
    t = _moving(spark, d)
    return p.interaction_features(t, world.scene_maps(t), conflict_points(spark, d))


def interaction_summary(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select(*p.PAIR, *(r4(c, F.least(F.col(c), F.lit(1e6))) for c in p.FEATURES))


def pair_threshold_score(spark: SparkSession, d: str) -> DataFrame:
    """Greatest 1/x of the measures of each pair over the steps at which they are critical: headways
    and times to collision below 2 s, decelerations above 0.5; 0 if there is no such step."""
    f = p.pair_measures(_moving(spark, d))

    def worst(c: str) -> Column:
        least = F.col(f"{c}_pos")
        return F.when(least < 2, 1 / least).otherwise(0.0)

    drac = F.when(F.col("drac") > 0.5, F.col("drac")).otherwise(0.0)
    return f.select(*p.PAIR, r4("thw", worst("thw")), r4("ttc", F.least(worst("ttc"), F.lit(1e6))), r4("drac", F.least(drac, F.lit(1e6))))


def target_distance(spark: SparkSession, d: str) -> DataFrame:
    t = world.tracks(spark, d)
    return rounded(p.min_distance_to_targets(t, world.targets(t)), "d")


def proximity_pooling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.proximity_pooling(k.with_motion(world.tracks(spark, d))), "pooled")


def scene_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Similarity exp(-d/10) of each ordered pair by its least distance."""
    near = p.aligned(world.tracks(spark, d)).groupBy(*p.PAIR).agg(F.min("d").alias("d"))
    both = near.union(near.select("scenario_id", F.col("j"), F.col("i"), "d"))
    return both.select(*p.PAIR, r4("similarity", F.exp(-F.col("d") / 10)))


SQL_ALIGNED = f"""
aligned AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, a.t, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj,
    {sql_norm('a.x-b.x','a.y-b.y')} AS d FROM tracks a JOIN tracks b ON a.scenario_id=b.scenario_id AND a.t=b.t
    AND a.agent_id < b.agent_id AND a.valid AND b.valid)"""
_deg = "abs({0} + 540.0::double - 360*floor(({0} + 540.0::double)/360) - 180)"
_S = f"WITH {SQL_TRACKS}"
_SA = f"WITH {SQL_TRACKS},{SQL_ALIGNED}"
_SM = f"WITH {SQL_TRACKS},{SQL_MOVING}"
_hd = _deg.format("(degrees(b.heading) - degrees(a.heading))")
SQL_FOLLOW = f"""
_lm AS (SELECT *, CASE WHEN agent_id%10<=5 THEN 4.5::double WHEN agent_id%10<=7 THEN 0.6::double ELSE 1.8::double END AS len FROM moving WHERE valid),
_ab AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, a.t, {sql_norm('a.x-b.x','a.y-b.y')} AS d,
   {_deg.format("(degrees(atan2(b.y-a.y, b.x-a.x)) - degrees(a.heading))")} <= 90 AS jl,
   a.x AS ax, a.y AS ay, a.speed AS av, a.heading AS ah, a.len AS al, b.x AS bx, b.y AS by, b.speed AS bv, b.heading AS bh, b.len AS bl
   FROM _lm a JOIN _lm b ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id<b.agent_id),
_lf AS (SELECT scenario_id, i, j, t, d, CASE WHEN jl THEN bv ELSE av END AS vl, CASE WHEN jl THEN av ELSE bv END AS vf,
   CASE WHEN jl THEN bx ELSE ax END AS xl, CASE WHEN jl THEN "by" ELSE ay END AS yl, CASE WHEN jl THEN ax ELSE bx END AS xf, CASE WHEN jl THEN ay ELSE "by" END AS yf,
   CASE WHEN jl THEN al ELSE bl END AS lf, CASE WHEN jl THEN ah ELSE bh END AS hf FROM _ab),
follow AS (SELECT scenario_id, i, j, t, d/(vf+0.0001::double) AS thw,
   CASE WHEN vf > vl THEN {sql_norm('xl-(xf+lf*cos(hf))','yl-(yf+lf*sin(hf))')}/(vf-vl) ELSE 'inf'::double END AS ttc,
   CASE WHEN vf > vl AND d > 0 THEN (vf-vl)*(vf-vl)/(2*d) ELSE 0 END AS drac FROM _lf)"""
SQL_CROSS = f"""
cross_ AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, a.t AS ti, min(b.t) AS tj, any_value(a.x) AS cx, any_value(a.y) AS cy
   FROM tracks a JOIN tracks b ON a.scenario_id=b.scenario_id AND a.agent_id<b.agent_id AND a.valid AND b.valid
   AND {sql_norm('a.x-b.x','a.y-b.y')} <= 1 GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1,2,3,4")
SQL_MTTCP = f"""
mttcp AS (SELECT c.scenario_id, c.i, c.j, min(abs({sql_norm('c.cx-a.x','c.cy-a.y')}/(a.speed+0.001::double) - {sql_norm('c.cx-b.x','c.cy-b.y')}/(b.speed+0.001::double))) AS mttcp,
   count(DISTINCT c.ti) AS n_crossings FROM cross_ c JOIN moving a ON a.scenario_id=c.scenario_id AND a.agent_id=c.i AND a.valid AND a.t <= least(c.ti,c.tj)
   JOIN moving b ON b.scenario_id=c.scenario_id AND b.agent_id=c.j AND b.valid AND b.t=a.t GROUP BY 1,2,3)"""


def _orient(ax, ay, bx, by, cx, cy):
    return f"sign(({bx}-{ax})*({cy}-{ay}) - ({by}-{ay})*({cx}-{ax}))"


def _within(ax, ay, bx, by, cx, cy):
    return f"({cx} BETWEEN least({ax},{bx}) AND greatest({ax},{bx}) AND {cy} BETWEEN least({ay},{by}) AND greatest({ay},{by}))"


def sql_meet(a: str, b: str) -> str:
    """Whether the last segments of rows ``a`` and ``b`` share a point."""
    A, B, C, D = (f"{a}.px", f"{a}.py"), (f"{a}.x", f"{a}.y"), (f"{b}.px", f"{b}.py"), (f"{b}.x", f"{b}.y")
    s1, s2, s3, s4 = _orient(*A, *B, *C), _orient(*A, *B, *D), _orient(*C, *D, *A), _orient(*C, *D, *B)
    return (
        f"(({s1} <> {s2} AND {s3} <> {s4}) OR ({s1}=0 AND {_within(*A, *B, *C)}) OR ({s2}=0 AND {_within(*A, *B, *D)})"
        f" OR ({s3}=0 AND {_within(*C, *D, *A)}) OR ({s4}=0 AND {_within(*C, *D, *B)}))"
    )


SQL_HITS = f"""
_sg AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tracks WHERE valid WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)),
hits AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, count(*) AS n_hits, min(a.t) AS first_t FROM _sg a JOIN _sg b
   ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id<b.agent_id
   WHERE {sql_norm('a.x-b.x','a.y-b.y')} <= 0.25 OR coalesce({sql_meet('a','b')}, false) GROUP BY 1,2,3)"""
SQL_CP = """
cp AS (SELECT s.scenario_id, lane_id AS cp_id, x AS cx, y AS cy FROM (SELECT DISTINCT scenario_id FROM tracks) s JOIN points ON pt=0 AND lane_id%15 = s.scenario_id%15)"""
LENGTH = "CASE WHEN agent_id%10<=5 THEN 4.5::double WHEN agent_id%10<=7 THEN 0.6::double ELSE 1.8::double END"


def sql_features(tag: str, left: str = "moving", right: str = "moving", rel: str = "<") -> str:
    """CTEs ending in ``{tag}`` (scenario_id, i, j, the features, min_d), i of ``left`` and j of ``right``."""
    one = lambda c: f"coalesce(CASE WHEN {c}=0 THEN 'inf'::double ELSE 1/{c} END, 0)"
    prev = f"SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, {LENGTH} AS len FROM {{}} WHERE valid WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)"
    near = f"""SELECT scenario_id, agent_id, cp_id, cx, cy, min({{{{'d': d, 't': t}}}}).t AS at FROM (SELECT m.*, cp_id, cx, cy, {sql_norm('x-cx','y-cy')} AS d FROM {{}} m JOIN cp USING (scenario_id) WHERE valid) WHERE d <= 5 GROUP BY 1,2,3,4,5"""
    return f"""
{tag}_a AS ({prev.format(left)}), {tag}_b AS ({prev.format(right)}),
{tag}_ab AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, {sql_norm('a.x-b.x','a.y-b.y')} AS d, {_deg.format("(degrees(atan2(b.y-a.y, b.x-a.x)) - degrees(a.heading))")} <= 90 AS jl,
   a.x AS ax, a.y AS ay, a.speed AS av, a.heading AS ah, a.len AS al, b.x AS bx, b.y AS by, b.speed AS bv, b.heading AS bh, b.len AS bl,
   {sql_norm('a.x-b.x','a.y-b.y')} <= 0.25 OR coalesce({sql_meet('a','b')}, false) AS hit
   FROM {tag}_a a JOIN {tag}_b b ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id {rel} b.agent_id),
{tag}_lf AS (SELECT scenario_id, i, j, d, hit, CASE WHEN jl THEN bv ELSE av END AS vl, CASE WHEN jl THEN av ELSE bv END AS vf,
   CASE WHEN jl THEN bx ELSE ax END AS xl, CASE WHEN jl THEN "by" ELSE ay END AS yl, CASE WHEN jl THEN ax ELSE bx END AS xf, CASE WHEN jl THEN ay ELSE "by" END AS yf,
   CASE WHEN jl THEN al ELSE bl END AS lf, CASE WHEN jl THEN ah ELSE bh END AS hf FROM {tag}_ab),
{tag}_p AS (SELECT scenario_id, i, j, min(d/(vf+0.0001::double)) AS thw, min(CASE WHEN vf > vl THEN {sql_norm('xl-(xf+lf*cos(hf))','yl-(yf+lf*sin(hf))')}/(vf-vl) ELSE 'inf'::double END) AS ttc,
   max(CASE WHEN vf > vl AND d > 0 THEN (vf-vl)*(vf-vl)/(2*d) ELSE 0 END) AS drac, count(*) FILTER (hit)::double AS collisions, min(d) AS min_d FROM {tag}_lf GROUP BY 1,2,3),
{tag}_c AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, a.t AS ti, min(b.t) AS tj, any_value(a.x) AS cx, any_value(a.y) AS cy
   FROM {left} a JOIN {right} b ON a.scenario_id=b.scenario_id AND a.agent_id {rel} b.agent_id AND a.valid AND b.valid AND {sql_norm('a.x-b.x','a.y-b.y')} <= 1 GROUP BY 1,2,3,4),
{tag}_m AS (SELECT c.scenario_id, c.i, c.j, min(abs({sql_norm('c.cx-a.x','c.cy-a.y')}/(a.speed+0.001::double) - {sql_norm('c.cx-b.x','c.cy-b.y')}/(b.speed+0.001::double))) AS mttcp
   FROM {tag}_c c JOIN {left} a ON a.scenario_id=c.scenario_id AND a.agent_id=c.i AND a.valid AND a.t <= least(c.ti,c.tj)
   JOIN {right} b ON b.scenario_id=c.scenario_id AND b.agent_id=c.j AND b.valid AND b.t=a.t GROUP BY 1,2,3),
{tag}_ni AS ({near.format(left).replace('{{','{').replace('}}','}')}), {tag}_nj AS ({near.format(right).replace('{{','{').replace('}}','}')}),
{tag}_s AS (SELECT n.scenario_id, n.agent_id AS i, o.agent_id AS j, min(abs({sql_norm('n.cx-x.x','n.cy-x.y')}/(x.speed+0.001::double) - {sql_norm('n.cx-y.x','n.cy-y.y')}/(y.speed+0.001::double))) AS scene_mttcp
   FROM {tag}_ni n JOIN {tag}_nj o ON o.scenario_id=n.scenario_id AND o.cp_id=n.cp_id AND n.agent_id {rel} o.agent_id
   JOIN {left} x ON x.scenario_id=n.scenario_id AND x.agent_id=n.agent_id AND x.valid AND x.t <= least(n.at, o.at)
   JOIN {right} y ON y.scenario_id=n.scenario_id AND y.agent_id=o.agent_id AND y.valid AND y.t=x.t GROUP BY 1,2,3),
{tag} AS (SELECT scenario_id, i, j, {one('thw')} AS thw, {one('ttc')} AS ttc, drac, {one('mttcp')} AS mttcp, {one('scene_mttcp')} AS scene_mttcp, collisions, min_d
   FROM {tag}_p LEFT JOIN {tag}_m USING (scenario_id, i, j) LEFT JOIN {tag}_s USING (scenario_id, i, j))"""


QUERIES = {
    "pair_unordered": (pair_unordered, f"{_S}, a AS (SELECT DISTINCT scenario_id, agent_id FROM tracks) SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j FROM a JOIN a b ON a.scenario_id=b.scenario_id AND a.agent_id<b.agent_id"),
    "pair_ordered_asym": (pair_ordered_asym, f"{_S}, a AS (SELECT DISTINCT scenario_id, agent_id FROM tracks) SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j FROM a JOIN a b ON a.scenario_id=b.scenario_id AND a.agent_id<>b.agent_id"),
    "pair_time_aligned": (pair_time_aligned, f"{_SA} SELECT scenario_id, i, j, count(*) AS n_common, {sql_r4('min(d)','min_d')}, {sql_r4('avg(d)','mean_d')} FROM aligned GROUP BY 1,2,3"),
    "encounters_within_100m": (encounters_within_100m, f'{_SA} SELECT scenario_id, i, j, {sql_r4("max(d)","max_d")}, min(t) AS start, max(t)+1 AS "end" FROM aligned GROUP BY 1,2,3 HAVING max(d) < 100'),
    "distance_trend": (distance_trend, f"{_SA} SELECT scenario_id, i, j, {sql_r4('regr_slope(d, t::double)','slope')} FROM aligned GROUP BY 1,2,3 HAVING regr_slope(d, t::double) IS NOT NULL"),
    "pair_status_cascade": (pair_status_cascade, f"""{_SM}, m AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, min({sql_norm('a.x-b.x','a.y-b.y')}) AS min_d, count(*) FILTER ({_hd} < 45) AS na
          FROM moving a JOIN moving b ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id<b.agent_id AND a.valid AND b.valid GROUP BY 1,2,3),
        s AS (SELECT scenario_id, agent_id, avg(speed) AS v FROM moving GROUP BY 1,2)
        SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, CASE WHEN na IS NULL THEN 'no_overlap' WHEN a.v<=0.25 AND b.v<=0.25 THEN 'stationary' WHEN min_d>=50 THEN 'too_far'
          WHEN na<2 THEN 'heading' ELSE 'ok' END AS status, {sql_r4('min_d','min_d')}
        FROM s a JOIN s b ON a.scenario_id=b.scenario_id AND a.agent_id<b.agent_id LEFT JOIN m ON m.scenario_id=a.scenario_id AND m.i=a.agent_id AND m.j=b.agent_id"""),
    "collisions_sync": (collisions_sync, f"{_S},{SQL_HITS} SELECT * FROM hits"),
    "trajectory_crossing": (trajectory_crossing, f"{_S},{SQL_CROSS} SELECT scenario_id, i, j, ti, tj FROM cross_"),
    "thw_ttc_drac": (thw_ttc_drac, f"{_SM},{SQL_FOLLOW} SELECT scenario_id, i, j, {sql_r4('min(thw)','min_thw')}, {sql_r4('least(min(ttc),1e6::double)','min_ttc')}, {sql_r4('least(max(drac),1e6::double)','max_drac')} FROM follow GROUP BY 1,2,3"),
    "agent_mttcp": (agent_mttcp, f"{_SM},{SQL_CROSS},{SQL_MTTCP} SELECT scenario_id, i, j, {sql_r4('mttcp','mttcp')}, n_crossings FROM mttcp"),
    "scene_mttcp": (scene_mttcp, f"""{_SM},{SQL_POINTS},{SQL_CP}, d AS (SELECT m.scenario_id, agent_id, cp_id, t, {sql_norm('x-cx','y-cy')} AS d, speed FROM moving m JOIN cp USING (scenario_id) WHERE valid),
        n AS (SELECT scenario_id, agent_id, cp_id, min({{'d': d, 't': t}}) AS b FROM d GROUP BY 1,2,3 HAVING min(d) <= 5),
        q AS (SELECT a.scenario_id, a.cp_id, a.agent_id AS i, b.agent_id AS j, least(a.b.t, b.b.t) AS e FROM n a JOIN n b ON a.scenario_id=b.scenario_id AND a.cp_id=b.cp_id AND a.agent_id<b.agent_id)
        SELECT q.scenario_id, q.i, q.j, {sql_r4('min(abs(x.d/(x.speed+0.001::double) - y.d/(y.speed+0.001::double)))','mttcp')}, count(DISTINCT q.cp_id) AS n_points FROM q
        JOIN d x ON x.scenario_id=q.scenario_id AND x.cp_id=q.cp_id AND x.agent_id=q.i AND x.t<=q.e JOIN d y ON y.scenario_id=q.scenario_id AND y.cp_id=q.cp_id AND y.agent_id=q.j AND y.t=x.t GROUP BY 1,2,3"""),
    "interaction_summary": (interaction_summary, f"{_SM},{SQL_POINTS},{SQL_CP},{sql_features('features')} SELECT scenario_id, i, j, " + ", ".join(sql_r4(f"least({c},1e6::double)", c) for c in p.FEATURES) + " FROM features"),
    "pair_threshold_score": (pair_threshold_score, f"""{_SM},{SQL_FOLLOW} SELECT scenario_id, i, j, {sql_r4('coalesce(max(1/thw) FILTER (thw < 2 AND thw > 0), 0)','thw')},
        {sql_r4('least(coalesce(max(1/ttc) FILTER (ttc < 2 AND ttc > 0), 0), 1e6::double)','ttc')}, {sql_r4('least(coalesce(max(drac) FILTER (drac > 0.5), 0), 1e6::double)','drac')} FROM follow GROUP BY 1,2,3"""),
    "target_distance": (target_distance, f"""{_SA}, u AS (SELECT scenario_id, i AS a, j AS b, d FROM aligned UNION ALL SELECT scenario_id, j, i, d FROM aligned),
        n AS (SELECT scenario_id, a, min(d) AS d FROM u WHERE b%10<=2 GROUP BY 1,2), g AS (SELECT DISTINCT scenario_id, agent_id FROM tracks)
        SELECT g.scenario_id, g.agent_id, {sql_r4('CASE WHEN agent_id%10<=2 THEN 0 ELSE d END','d')} FROM g LEFT JOIN n ON n.scenario_id=g.scenario_id AND n.a=g.agent_id"""),
    "proximity_pooling": (proximity_pooling, f"""{_SM},{SQL_ALIGNED}, n AS (SELECT scenario_id, i, j, min(d) AS d FROM aligned GROUP BY 1,2,3), u AS (SELECT scenario_id, i AS a, j AS b, d FROM n UNION ALL SELECT scenario_id, j, i, d FROM n),
        v AS (SELECT scenario_id, agent_id, avg(speed) AS v FROM moving GROUP BY 1,2)
        SELECT u.scenario_id, u.a AS agent_id, {sql_r4('sum(exp(-d/1.2::double)*v)/nullif(sum(exp(-d/1.2::double)),0)','pooled')} FROM u JOIN v ON v.scenario_id=u.scenario_id AND v.agent_id=u.b GROUP BY 1,2"""),
    "scene_adjacency": (scene_adjacency, f"""{_SA}, n AS (SELECT scenario_id, i, j, {sql_r4('exp(-min(d)/10)','similarity')} FROM aligned GROUP BY 1,2,3) SELECT * FROM n UNION ALL SELECT scenario_id, j AS i, i AS j, similarity FROM n"""),
}
