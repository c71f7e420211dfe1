"""Registered queries over lanes and road frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, exact_mean, heading_difference, miles_per_hour, round_
from scenelake.operators import kinematics as k
from scenelake.operators import lanes as ln
from scenelake.operators import pairs as pr
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.plans.kinematics import SQL_MOVING
from scenelake.plans.pairs import SQL_CP, conflict_points
from scenelake.sources import world
from scenelake.sources.world import SQL_LANES, SQL_POINTS, SQL_TRACKS

A = k.AGENT


def _map(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    t = world.tracks(spark, d)
    return t, world.scene_maps(t), world.lanes(spark, d), world.lane_points(spark, d)


def _near(spark: SparkSession, d: str, k_: int = 16) -> DataFrame:
    return ln.nearest(*_map(spark, d), k_)


def _in_lane(spark: SparkSession, d: str) -> DataFrame:
    """The nearest lane of each valid step that has one within 5 m."""
    return ln.near(*_map(spark, d), k=1)


def _at(spark: SparkSession, d: str) -> DataFrame:
    """Each valid step with its nearest lane."""
    near = _near(spark, d, 1).select(*A, "t", "lane_id")
    return world.tracks(spark, d).where("valid").join(near, [*A, "t"])


def polyline_direction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ln.directions(world.lane_points(spark, d)), "dir_x", "dir_y")


def polyline_break_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = ln.break_and_chunk(world.lane_points(spark, d))
    return c.groupBy("lane_id", "part", "chunk").agg(F.count("*").cast("long").alias("n"), F.min("pt").alias("first_pt"), r4("cx", F.avg("x")), r4("cy", F.avg("y"))).withColumn("part", F.col("part").cast("long"))


def arc_length(spark: SparkSession, d: str) -> DataFrame:
    return ln.arc_length(world.lane_points(spark, d)).select("lane_id", "pt", r4("s"))


def polyline_centroid(spark: SparkSession, d: str) -> DataFrame:
    return world.lane_points(spark, d).groupBy("lane_id").agg(*((round_(F.avg(c), 8) + 0.0).alias(f"c{c}") for c in "xy"))


def lane_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the lane graph, in both directions, that exist."""
    lanes = world.lanes(spark, d)
    e = lanes.select(F.col("lane_id").alias("src"), F.col("exit_lane").alias("dst")).join(lanes.select(F.col("lane_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return e.union(e.select(F.col("dst"), F.col("src")))


def lane_intersections(spark: SparkSession, d: str) -> DataFrame:
    return ln.intersections(world.lane_points(spark, d), world.lanes(spark, d))


def conflict_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least distance of each agent to each conflict point within 5 m of its track, and its first step."""
    t = world.tracks(spark, d)
    near = pr.nearest_to_points(t, world.scene_maps(t), conflict_points(spark, d), 5.0)
    return near.select(*A, "cp_id", r4("d"), "t")


def knn_lanes(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d)
    return near.groupBy(*A, "lane_id").agg(F.count("*").alias("n_steps"), exact_mean(F.col("d")).alias("mean_d"), F.min("rank").alias("best_rank"))


def best_lane(spark: SparkSession, d: str) -> DataFrame:
    """The lane of each agent that is most similar to its track, in distance and in shape."""
    return ln.most_similar(*_map(spark, d)).select(*A, "lane_id", r4("sim"))


def topk_polylines(spark: SparkSession, d: str) -> DataFrame:
    """The 8 polylines nearest by centroid to the point 30 m ahead of each target now."""
    from pyspark.sql import Window

    m = k.with_motion(world.tracks(spark, d)).where((F.col("t") == world.NOW) & (F.col("agent_id") % 10 <= 2))
    ahead = m.select(*A, (F.col("x") + 30 * F.cos("heading")).alias("ox"), (F.col("y") + 30 * F.sin("heading")).alias("oy"))
    lanes = ln.with_lanes(world.scene_maps(m), world.lanes(spark, d)).join(polyline_centroid(spark, d), "lane_id")
    near = ahead.join(lanes, "scenario_id").withColumn("d", round_(dist(F.col("ox"), F.col("oy"), F.col("cx"), F.col("cy")), 4))
    w = Window.partitionBy(*A).orderBy("d", "lane_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select(*A, "rank", "lane_id", "d")


def map_collection(spark: SparkSession, d: str) -> DataFrame:
    """Lanes near each target at its first and at its last valid step, as one set."""
    near = _near(spark, d, 4).where(F.col("agent_id") % 10 <= 2)
    ends = near.groupBy(*A).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    first = near.join(ends, A).where("t = a").select(*A, "lane_id")
    last = near.join(ends, A).where("t = b").select(*A, "lane_id")
    return first.unionByName(last).distinct()


def lane_activity_intervals(spark: SparkSession, d: str) -> DataFrame:
    return ln.activity(*_map(spark, d))


def interval_stab(spark: SparkSession, d: str) -> DataFrame:
    """Active lanes of each agent now."""
    act = ln.activity(*_map(spark, d), at=world.NOW)
    now = world.tracks(spark, d).where(F.col("t") == world.NOW).select(*A, "t")
    return ln.stab(act, now, A).groupBy(*A).agg(F.count("*").alias("n_active"), F.min("lane_id").alias("first_lane"))


def cartesian_to_road(spark: SparkSession, d: str) -> DataFrame:
    road = ln.to_road(_at(spark, d), ln.segments(world.lane_points(spark, d)), [*A, "t"])
    return road.select(*A, "t", "lane_id", r4("s"), r4("d"))


def cartesian_to_road_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Projections that fall inside their segment and within 2.5 m of it."""
    road = ln.to_road(_at(spark, d), ln.segments(world.lane_points(spark, d)), [*A, "t"], clamp=False)
    return road.where(F.abs("d") <= 2.5).select(*A, "t", "lane_id", r4("s"), r4("d"))


def road_to_cartesian(spark: SparkSession, d: str) -> DataFrame:
    """Each lane's places every 5 m along it and 1 m to its left."""
    s = ln.segments(world.lane_points(spark, d))
    length = s.groupBy("lane_id").agg(F.floor((F.max(F.col("s") + F.col("len")) - 0.001) / 5).cast("int").alias("n"))
    places = length.select("lane_id", F.explode(F.sequence(F.lit(0), "n")).alias("i")).select("lane_id", "i", (F.col("i") * 5.0).alias("s"), F.lit(1.0).alias("d"))
    return ln.to_cartesian(places, s, ["i"]).select("lane_id", "i", r4("cx"), r4("cy"))


def lane_angle_gate(spark: SparkSession, d: str) -> DataFrame:
    """Steps whose heading agrees with their nearest lane within 45 degrees either way, or that are slow."""
    m = k.with_motion(world.tracks(spark, d)).where("valid").join(_near(spark, d, 1).select(*A, "t", "lane_id"), [*A, "t"])
    ends = world.lane_points(spark, d).groupBy("lane_id").agg(F.min(F.struct("pt", "x", "y")).alias("a"), F.max(F.struct("pt", "x", "y")).alias("b"))
    lane = ends.select("lane_id", F.degrees(F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))).alias("lane_deg"))
    deg = heading_difference(F.degrees("heading"), F.col("lane_deg"))
    ok = (deg < 45) | (deg > 135) | (F.col("speed") < 1)
    return m.join(lane, "lane_id").groupBy(*A).agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))


def speed_limit_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Greatest excess over the limit of the nearest lane within 5 m; 0 outside lanes."""
    m = k.with_motion(world.tracks(spark, d)).where("valid").join(_in_lane(spark, d).select(*A, "t", "lane_id"), [*A, "t"], "left")
    lim = world.lanes(spark, d).select("lane_id", miles_per_hour(F.col("limit_mph")).alias("limit"))
    over = m.join(lim, "lane_id", "left").groupBy(*A).agg(F.max(F.col("speed") - F.col("limit")).alias("o"), F.count("lane_id").alias("n_in_lane"))
    return over.select(*A, r4("over_limit", F.greatest(F.coalesce("o", F.lit(0.0)), F.lit(0.0))), "n_in_lane")


def distinct_lanes(spark: SparkSession, d: str) -> DataFrame:
    return _in_lane(spark, d).groupBy(*A).agg(F.countDistinct("lane_id").alias("n_lanes"))


def lane_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of agents whose nearest lanes have one in common, with how many."""
    u = _in_lane(spark, d).select(*A, "lane_id").distinct()
    a, b = (u.select("scenario_id", "lane_id", F.col("agent_id").alias(n)) for n in "ij")
    return a.join(b, ["scenario_id", "lane_id"]).where("i < j").groupBy("scenario_id", "i", "j").agg(F.count("*").alias("n_shared"))


_PW = "WINDOW w AS (PARTITION BY lane_id ORDER BY pt)"
SQL_SEG = f"""
_al AS (SELECT *, coalesce({sql_norm('x-lag(x) OVER w','y-lag(y) OVER w')},0) AS st, lead(x) OVER w AS bx, lead(y) OVER w AS "by" FROM points {_PW}),
segs AS (SELECT lane_id, pt AS seg, x AS ax, y AS ay, bx, "by", sum(st) OVER w2 AS s, {sql_norm('x-bx','y-"by"')} AS len FROM _al
   WINDOW w2 AS (PARTITION BY lane_id ORDER BY pt ROWS UNBOUNDED PRECEDING) QUALIFY bx IS NOT NULL)"""


def _share(o: str) -> str:
    ux, uy = f"({o}x-vx)", f"({o}y-vy)"
    return f"(((x-vx)*{ux} + (y-vy)*{uy})/nullif({ux}*{ux}+{uy}*{uy},0))"


SQL_NEAR = f"""
_ap AS (SELECT lane_id, pt, x AS vx, y AS vy, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM points {_PW}),
_v AS (SELECT t.scenario_id, t.agent_id, t.t, l.lane_id, t.x, t.y, p.* EXCLUDE (lane_id), round({sql_norm('t.x-p.vx','t.y-p.vy')},6) AS vd
   FROM tracks t JOIN lanes l ON l.map_id = t.scenario_id % 15 JOIN _ap p ON p.lane_id=l.lane_id WHERE t.valid
   QUALIFY row_number() OVER (PARTITION BY t.scenario_id, t.agent_id, t.t, l.lane_id ORDER BY round({sql_norm('t.x-p.vx','t.y-p.vy')},6), p.pt) = 1),
_u AS (SELECT *, {_share('n')} AS un, {_share('p')} AS up FROM _v),
_o AS (SELECT *, CASE WHEN vd <= 10 AND un BETWEEN 0 AND 1 THEN round({sql_norm('x-(vx+un*(nx-vx))', 'y-(vy+un*(ny-vy))')}, 6) ELSE 'inf'::double END AS dn,
   CASE WHEN vd <= 10 AND up BETWEEN 0 AND 1 THEN round({sql_norm('x-(vx+up*(px-vx))', 'y-(vy+up*(py-vy))')}, 6) ELSE 'inf'::double END AS dp FROM _u),
_d AS (SELECT scenario_id, agent_id, t, lane_id, x, y, least(vd, dn, dp) AS d,
   CASE WHEN vd <= dn AND vd <= dp THEN vx WHEN dn <= dp THEN vx+un*(nx-vx) ELSE vx+up*(px-vx) END AS qx,
   CASE WHEN vd <= dn AND vd <= dp THEN vy WHEN dn <= dp THEN vy+un*(ny-vy) ELSE vy+up*(py-vy) END AS qy FROM _o),
near AS (SELECT scenario_id, agent_id, t, lane_id, x, y, d, qx, qy, CAST(row_number() OVER (PARTITION BY scenario_id, agent_id, t ORDER BY d, lane_id) AS INT) AS rank FROM _d)"""
_P = f"WITH {SQL_POINTS}"
_N = f"WITH {SQL_TRACKS},{SQL_POINTS},{SQL_LANES},{SQL_NEAR}"
_NM = f"WITH {SQL_TRACKS},{SQL_MOVING},{SQL_POINTS},{SQL_LANES},{SQL_NEAR}"
SQL_ACT = """
_ac AS (SELECT *, t - row_number() OVER (PARTITION BY scenario_id, agent_id, lane_id ORDER BY t) AS g FROM near WHERE greatest(0, 1-d/5) > 0.5),
act AS (SELECT scenario_id, agent_id, lane_id, min(t) AS start, max(t)+1 AS "end", sum(CAST(round(d*1000000) AS BIGINT))/count(d)/1000000.0::double AS mean_d FROM _ac GROUP BY scenario_id, agent_id, lane_id, g)"""
SQL_ROAD = f"""
_rb AS (SELECT n.scenario_id, n.agent_id, n.t, n.lane_id, n.x, n.y, g.* EXCLUDE (lane_id) FROM near n JOIN segs g ON g.lane_id=n.lane_id WHERE n.rank=1 AND g.len*g.len > 1e-8
   QUALIFY row_number() OVER (PARTITION BY n.scenario_id, n.agent_id, n.t ORDER BY round({sql_norm('n.x-g.ax','n.y-g.ay')} + {sql_norm('n.x-g.bx','n.y-g."by"')}, 6), g.seg) = 1),
_ru AS (SELECT *, ((x-ax)*(bx-ax) + (y-ay)*("by"-ay))/(len*len) AS u0 FROM _rb)"""


def _road(u: str) -> str:
    px, py = f"(ax+{u}*(bx-ax))", f"(ay+{u}*(\"by\"-ay))"
    d = f"(CASE WHEN (bx-ax)*(y-ay) - (\"by\"-ay)*(x-ax) >= 0 THEN 1.0::double ELSE -1.0::double END)*{sql_norm(f'x-{px}', f'y-{py}')}"
    return f"SELECT scenario_id, agent_id, t, lane_id, {sql_r4(f's+{u}*len','s')}, {sql_r4(d,'d')} FROM _ru"


_hd = "abs(({0} + 540.0::double) - 360*floor(({0} + 540.0::double)/360) - 180)".format("(degrees(atan2(ly,lx)) - degrees(heading))")

QUERIES = {
    "polyline_direction": (polyline_direction, f"""{_P}, q AS (SELECT *, x-lag(x) OVER w AS dx, y-lag(y) OVER w AS dy FROM points {_PW})
        SELECT lane_id, pt, {sql_r4('coalesce(dx/greatest(sqrt(dx*dx+dy*dy),1e-6::double),0)','dir_x')}, {sql_r4('coalesce(dy/greatest(sqrt(dx*dx+dy*dy),1e-6::double),0)','dir_y')} FROM q"""),
    "polyline_break_chunk": (polyline_break_chunk, f"""{_P}, q AS (SELECT *, coalesce({sql_norm('x-lag(x) OVER w','y-lag(y) OVER w')} > 1, false)::int AS g FROM points {_PW}), r AS (SELECT *, CAST(sum(g) OVER w AS BIGINT) AS part FROM q {_PW}),
        c AS (SELECT *, CAST((row_number() OVER (PARTITION BY lane_id, part ORDER BY pt) - 1)//20 AS INT) AS chunk FROM r)
        SELECT lane_id, part, chunk, count(*) AS n, min(pt) AS first_pt, {sql_r4('avg(x)','cx')}, {sql_r4('avg(y)','cy')} FROM c GROUP BY 1,2,3"""),
    "arc_length": (arc_length, f"""{_P}, q AS (SELECT *, coalesce({sql_norm('x-lag(x) OVER w','y-lag(y) OVER w')},0) AS st FROM points {_PW}) SELECT lane_id, pt, {sql_r4('sum(st) OVER (PARTITION BY lane_id ORDER BY pt ROWS UNBOUNDED PRECEDING)','s')} FROM q"""),
    "polyline_centroid": (polyline_centroid, f"{_P} SELECT lane_id, round(avg(x),8) + 0.0::double AS cx, round(avg(y),8) + 0.0::double AS cy FROM points GROUP BY 1"),
    "lane_edges": (lane_edges, f"WITH {SQL_LANES}, e AS (SELECT lane_id AS src, exit_lane AS dst FROM lanes WHERE exit_lane IN (SELECT lane_id FROM lanes)) SELECT src, dst FROM e UNION ALL SELECT dst AS src, src AS dst FROM e"),
    "lane_intersections": (lane_intersections, f"""WITH {SQL_POINTS},{SQL_LANES}, p AS (SELECT * FROM points JOIN lanes USING (lane_id)) SELECT a.lane_id AS i, b.lane_id AS j, count(*) AS n_points FROM p a JOIN p b
        ON a.map_id=b.map_id AND a.lane_id<b.lane_id AND b.lane_id<>a.exit_lane AND {sql_norm('a.x-b.x','a.y-b.y')} < 0.05::double GROUP BY 1,2"""),
    "conflict_distance": (conflict_distance, f"""WITH {SQL_TRACKS},{SQL_POINTS},{SQL_CP}, q AS (SELECT t.scenario_id, agent_id, cp_id, min({{'d': {sql_norm('x-cx','y-cy')}, 't': t}}) AS b FROM tracks t JOIN cp USING (scenario_id) WHERE valid AND {sql_norm('x-cx','y-cy')} <= 5 GROUP BY 1,2,3)
        SELECT scenario_id, agent_id, cp_id, {sql_r4('b.d','d')}, b.t AS t FROM q"""),
    "knn_lanes": (knn_lanes, f"{_N} SELECT scenario_id, agent_id, lane_id, count(*) AS n_steps, sum(CAST(round(d*1000000) AS BIGINT))/count(d)/1000000.0::double AS mean_d, min(rank) AS best_rank FROM near WHERE rank<=16 GROUP BY 1,2,3"),
    "best_lane": (best_lane, f"""{_N}, o AS (SELECT scenario_id, agent_id, lane_id, t, d, x-qx AS ox, y-qy AS oy, last(x-qx) OVER w AS lx, last(y-qy) OVER w AS ly FROM near
          WINDOW w AS (PARTITION BY scenario_id, agent_id, lane_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        m AS (SELECT scenario_id, agent_id, lane_id, round(1/greatest(round(sum(CAST(round(d*1000000) AS BIGINT))/count(d)/1000000.0::double,8) + round(avg({sql_norm('ox-lx','oy-ly')}),8),1e-8::double),6) AS sim FROM o GROUP BY 1,2,3)
        SELECT scenario_id, agent_id, lane_id, {sql_r4('sim','sim')} FROM m QUALIFY row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY sim DESC, lane_id)=1"""),
    "topk_polylines": (topk_polylines, f"""WITH {SQL_TRACKS},{SQL_MOVING},{SQL_POINTS},{SQL_LANES}, c AS (SELECT lane_id, round(avg(x),8) AS cx, round(avg(y),8) AS cy FROM points GROUP BY 1),
        q AS (SELECT m.scenario_id, m.agent_id, l.lane_id, round({sql_norm('m.x+30*cos(heading)-cx','m.y+30*sin(heading)-cy')},4) AS d FROM moving m JOIN lanes l ON l.map_id=m.scenario_id%15 JOIN c USING (lane_id) WHERE t=10 AND agent_id%10<=2)
        SELECT scenario_id, agent_id, CAST(row_number() OVER w AS INT) AS rank, lane_id, d FROM q WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY d, lane_id) QUALIFY row_number() OVER w <= 8"""),
    "map_collection": (map_collection, f"""{_N}, n AS (SELECT *, min(t) OVER (PARTITION BY scenario_id, agent_id) AS a, max(t) OVER (PARTITION BY scenario_id, agent_id) AS b FROM near WHERE rank<=4 AND agent_id%10<=2)
        SELECT DISTINCT scenario_id, agent_id, lane_id FROM n WHERE t=a OR t=b"""),
    "lane_activity_intervals": (lane_activity_intervals, f'{_N},{SQL_ACT} SELECT scenario_id, agent_id, lane_id, start, "end", mean_d FROM act'),
    "interval_stab": (interval_stab, f'{_N},{SQL_ACT} SELECT t.scenario_id, t.agent_id, count(*) AS n_active, min(lane_id) AS first_lane FROM tracks t JOIN act a ON a.scenario_id=t.scenario_id AND a.agent_id=t.agent_id AND t.t>=a.start AND t.t<a."end" WHERE t.t=10 GROUP BY 1,2'),
    "cartesian_to_road": (cartesian_to_road, f"{_N},{SQL_SEG},{SQL_ROAD} {_road('least(greatest(u0,0),1)')}"),
    "cartesian_to_road_bounded": (cartesian_to_road_bounded, f"{_N},{SQL_SEG},{SQL_ROAD}, z AS ({_road('u0')} WHERE u0 BETWEEN 0 AND 1) SELECT * FROM z WHERE abs(d) <= 2.5"),
    "road_to_cartesian": (road_to_cartesian, f"""{_P},{SQL_SEG}, l AS (SELECT lane_id, CAST(floor((max(s+len)-0.001::double)/5) AS INT) AS n FROM segs GROUP BY 1), q AS (SELECT lane_id, CAST(unnest(range(n+1)) AS INT) AS i FROM l),
        g AS (SELECT q.lane_id, q.i, s.*  EXCLUDE (lane_id) FROM q JOIN segs s ON s.lane_id=q.lane_id AND s.len>0 AND s.s <= q.i*5.0::double + 1e-9::double QUALIFY row_number() OVER (PARTITION BY q.lane_id, q.i ORDER BY s.s DESC, s.seg DESC)=1)
        SELECT lane_id, i, {sql_r4('ax + (i*5-s)*(bx-ax)/len - ("by"-ay)/len','cx')}, {sql_r4('ay + (i*5-s)*("by"-ay)/len + (bx-ax)/len','cy')} FROM g"""),
    "lane_angle_gate": (lane_angle_gate, f"""{_NM}, e AS (SELECT lane_id, arg_max(x,pt)-arg_min(x,pt) AS lx, arg_max(y,pt)-arg_min(y,pt) AS ly FROM points GROUP BY 1)
        SELECT m.scenario_id, m.agent_id, count(*) FILTER ({_hd} < 45 OR {_hd} > 135 OR speed < 1) AS n_ok, count(*) AS n FROM moving m JOIN near n ON n.scenario_id=m.scenario_id AND n.agent_id=m.agent_id AND n.t=m.t AND n.rank=1 JOIN e ON e.lane_id=n.lane_id GROUP BY 1,2"""),
    "speed_limit_lookup": (speed_limit_lookup, f"""{_NM} SELECT m.scenario_id, m.agent_id, {sql_r4('greatest(coalesce(max(speed - limit_mph*(1.609344::double*1000/3600)),0),0)','over_limit')}, count(n.lane_id) AS n_in_lane
        FROM moving m LEFT JOIN near n ON n.scenario_id=m.scenario_id AND n.agent_id=m.agent_id AND n.t=m.t AND n.rank=1 AND n.d<=5 LEFT JOIN lanes l ON l.lane_id=n.lane_id WHERE m.valid GROUP BY 1,2"""),
    "distinct_lanes": (distinct_lanes, f"{_N} SELECT scenario_id, agent_id, count(DISTINCT lane_id) AS n_lanes FROM near WHERE rank=1 AND d<=5 GROUP BY 1,2"),
    "lane_sharing": (lane_sharing, f"""{_N}, u AS (SELECT DISTINCT scenario_id, agent_id, lane_id FROM near WHERE rank=1 AND d<=5) SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, count(*) AS n_shared FROM u a JOIN u b
        ON a.scenario_id=b.scenario_id AND a.lane_id=b.lane_id AND a.agent_id<b.agent_id GROUP BY 1,2,3"""),
}
