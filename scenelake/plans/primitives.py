"""Registered queries: primitives, clusters, road-frame assessment, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, round_
from scenelake.operators import grouped
from scenelake.operators import kinematics as k
from scenelake.operators import lanes as ln
from scenelake.operators import pairs as pr
from scenelake.operators import primitives as pm
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.plans.kinematics import SQL_MOVING
from scenelake.plans.lanes import SQL_NEAR, SQL_ROAD, SQL_SEG, _at, _in_lane, _map
from scenelake.sources import world
from scenelake.sources.world import SQL_LANES, SQL_POINTS, SQL_TRACKS
from scenelake.streaming import files

A = k.AGENT


def _states(spark: SparkSession, d: str) -> DataFrame:
    """The quarter of each valid step's heading."""
    m = k.with_motion(world.tracks(spark, d)).where("valid")
    return m.select(*A, "t", F.least(F.floor((F.col("heading") + 3.141592653589793) / 1.5707963267948966), F.lit(3)).alias("state"))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """Endpoint motion of each agent over its valid span, as (agent_id, x, y)."""
    at = F.struct("t", "x", "y")
    e = world.tracks(spark, d).where("valid").groupBy(*A).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return e.select("scenario_id", "agent_id", round_(F.col("b.x") - F.col("a.x"), 2).alias("x"), round_(F.col("b.y") - F.col("a.y"), 2).alias("y"))


def state_runs(spark: SparkSession, d: str) -> DataFrame:
    return pm.state_runs(_states(spark, d), "state")


def segment_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Segments between the steps at which an agent's heading quarter changes."""
    runs = pm.state_runs(_states(spark, d), "state").select(*A, F.col("start").alias("c"))
    last = _states(spark, d).groupBy(*A).agg(F.max("t").alias("c"))
    return pm.segment_bounds(runs.unionByName(last).distinct())


def primitive_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many agents have how many primitives, and their mean length."""
    r = state_runs(spark, d).groupBy(*A).agg(F.count("*").alias("n_prims"), F.sum(F.col("end") - F.col("start")).alias("steps"))
    return r.groupBy("n_prims").agg(F.count("*").alias("n_agents"), r4("mean_length", F.sum("steps") / F.sum("n_prims")))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints by the nearest of the ten label means of the first two embedding values."""
    e = world.table(spark, d, "embeddings")
    c = e.groupBy(F.col("label").alias("k")).agg(*((F.sum(F.round(F.col("embedding")[i].cast("double") * 1000000).cast("long")) / F.count("*") / 1000.0).alias(f"c{n}") for i, n in enumerate("xy")))
    return pm.nearest_centroid(_ends(spark, d), c, "agent_id").select("agent_id", "k", "dist")


def lloyd_fixed_iters(spark: SparkSession, d: str) -> DataFrame:
    return pm.lloyd(_ends(spark, d), 4, 2, "agent_id").select("agent_id", "k", "dist")


def anomaly_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Length-weighted mean distance of each agent's runs of five steps or more, over sqrt(303)."""
    r = state_runs(spark, d).withColumn("len", F.col("end") - F.col("start")).where("len >= 5")
    s = r.withColumn("dist", F.abs(F.col("state") - 1.5) * F.col("len"))
    g = s.groupBy(*A).agg((F.sum(F.col("dist") * F.col("len")) / F.sum("len") / F.sqrt(F.lit(303.0))).alias("a"))
    every = world.tracks(spark, d).select(*A).distinct()
    return every.join(g, A, "left").select(*A, r4("anomaly", F.coalesce("a", F.lit(0.0))))


def pair_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """The greater anomaly of the two agents of each pair."""
    a = anomaly_weighted(spark, d)
    i, j = (a.select("scenario_id", F.col("agent_id").alias(n), F.col("anomaly").alias(f"a{n}")) for n in "ij")
    pairs = pr.unordered(world.tracks(spark, d))
    both = pairs.join(i, ["scenario_id", "i"], "left").join(j, ["scenario_id", "j"], "left")
    return both.select(*pr.PAIR, F.greatest("ai", "aj").alias("anomaly"))


def medoid(spark: SparkSession, d: str) -> DataFrame:
    """The endpoint of each scenario with the least mean distance to the others."""
    e = _ends(spark, d)
    o = e.select("scenario_id", F.col("agent_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    m = e.join(o, "scenario_id").where("agent_id <> o").groupBy(*A).agg(round_(F.avg(dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))), 6).alias("m"))
    return m.groupBy("scenario_id").agg(F.min(F.struct("m", "agent_id")).alias("b")).select("scenario_id", F.col("b.agent_id").alias("agent_id"), F.col("b.m").alias("mean_d"))


def silhouette_from_distance(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes of endpoints within each scenario, clusters by object type."""
    e = world.with_type(_ends(spark, d)).select("agent_id", F.col("object_type").alias("k"), "x", "y", F.col("scenario_id").alias("block"))
    return rounded(pm.silhouette(e, "agent_id"), "a", "b", "s")


def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    """Label of each endpoint by the five nearest of its scenario, ties to the smaller label."""
    e = _ends(spark, d)
    o = e.select("scenario_id", F.col("agent_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("agent_id") % 3).alias("label"))
    n = e.join(o, "scenario_id").where("agent_id <> o").withColumn("d", round_(dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")), 6))
    n = n.withColumn("r", F.row_number().over(Window.partitionBy(*A).orderBy("d", "o"))).where("r <= 5")
    v = n.groupBy(*A, "label").agg((-F.count("*")).alias("votes"))
    return v.groupBy(*A).agg(F.min(F.struct("votes", "label"))["label"].alias("label"))


def procrustes_rmsd(spark: SparkSession, d: str) -> DataFrame:
    """RMSD of each agent's track to that of agent 1, over their common steps, after the best rotation."""
    shapes = world.tracks(spark, d).select(*A, F.col("t").alias("i"), "x", "y")
    ref = shapes.where("agent_id = 1 and scenario_id = 0")
    mid = ref.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    ref = ref.crossJoin(F.broadcast(mid)).select("i", (F.col("x") - F.col("mx")).alias("rx"), (F.col("y") - F.col("my")).alias("ry"))
    return pm.align_2d(shapes, F.broadcast(ref), A).select(*A, r4("rmsd"))


def coverage_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Agents of each type, moving or not, with the mean shares of valid and in-lane steps."""
    t = world.with_type(k.with_motion(world.tracks(spark, d)))
    near = _in_lane(spark, d).select(*A, "t", F.lit(1).alias("in_lane"))
    g = t.join(near, [*A, "t"], "left").groupBy(*A, "object_type").agg(
        (F.avg("speed") < 0.25).alias("stationary"), (F.count_if("valid") / F.count("*")).alias("valid"), (F.count("in_lane") / F.count("*")).alias("lane")
    )
    return g.groupBy("object_type", "stationary").agg(F.count("*").alias("n"), r4("valid", F.avg("valid")), r4("lane", F.avg("lane")))


def mask_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Error of holding the last velocity when the last 30, 60 or 90 per cent of valid steps are masked."""
    v = pm.valid_steps(k.velocity(world.tracks(spark, d)))
    rates = F.explode(F.array(*(F.lit(r) for r in (3, 6, 9)))).alias("tenths")
    r = v.select("*", rates).withColumn("kept", F.col("rn") * 10 <= F.col("n") * (10 - F.col("tenths")))
    last = r.where("kept").groupBy(*A, "tenths").agg(F.max(F.struct("t", "x", "y", "vx", "vy")).alias("l"))
    gone = r.where("not kept").join(last, [*A, "tenths"])
    dt = (F.col("t") - F.col("l.t")) * k.H
    err = dist(F.col("x"), F.col("y"), F.col("l.x") + F.col("l.vx") * dt, F.col("l.y") + F.col("l.vy") * dt)
    return gone.groupBy("tenths").agg(F.count("*").alias("n"), r4("mean_error", F.avg(err)))


def forecast_error(spark: SparkSession, d: str) -> DataFrame:
    """Constant-velocity forecast from now on: mean and last error of each agent."""
    m = k.velocity(world.tracks(spark, d)).where("valid")
    now = m.where(F.col("t") == world.NOW).select(*A, F.col("x").alias("nx"), F.col("y").alias("ny"), "vx", "vy")
    f = m.where(F.col("t") > world.NOW).select(*A, "t", "x", "y").join(now, A)
    dt = (F.col("t") - world.NOW) * k.H
    f = f.withColumn("e", dist(F.col("x"), F.col("y"), F.col("nx") + F.col("vx") * dt, F.col("ny") + F.col("vy") * dt))
    return f.groupBy(*A).agg(r4("ade", F.avg("e")), r4("fde", F.max(F.struct("t", "e"))["e"]))


def road_frame_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Per scenario: counts by type, extremes of the offset from the centreline, speed statistics."""
    road = ln.to_road(_at(spark, d), ln.segments(world.lane_points(spark, d)), [*A, "t"]).select(*A, "t", "d")
    m = world.with_type(k.with_motion(world.tracks(spark, d)).where("valid")).join(road, [*A, "t"])
    kinds = [F.countDistinct(F.when(F.col("object_type") == f"TYPE_{n.upper()}", F.col("agent_id"))).alias(f"n_{n}") for n in ("vehicle", "pedestrian", "cyclist")]
    return m.groupBy("scenario_id").agg(
        *kinds, r4("max_d", F.max(F.abs("d"))), r4("mean_speed", F.avg("speed")), r4("std_speed", F.stddev_pop("speed")), r4("max_speed", F.max("speed"))
    )


def change_points_cubic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pm.cubic_primitives(world.tracks(spark, d)), "error")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return world.table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def kmeans_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of 8 clusters of endpoint motion by MLlib's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = _ends(spark, d).select("agent_id", array_to_vector(F.array("x", "y")).alias("features"))
    model = KMeans(k=8, seed=42).fit(e)
    return model.transform(e).groupBy(F.col("prediction").alias("k")).agg(F.count("*").alias("n"))


def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance of the first 16 components and its running sum."""
    from pyspark.ml.feature import PCA

    model = PCA(k=16, inputCol="features", outputCol="p").fit(_vectors(spark, d))
    v = model.explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i, float(x), float(sum(v[: i + 1]))) for i, x in enumerate(v)], "component int, share double, total double")


def stream_available_now(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of each file of ``events`` that is new, written by a stream that stops by itself."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='scenelake-')}"
    sink, log = (f"{base}/stream-{uuid.uuid4().hex}/{n}" for n in ("sink", "log"))
    schema = world.table(spark, d, "events").schema
    keep = lambda s: s.where("event_type = 'purchase'").select("event_id", "user_id", "value")
    files.process_new(spark, f"{d}/events*.parquet", schema, sink, log, keep)
    return spark.read.parquet(sink)


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with gaps below 30 minutes."""
    s = files.sessions(world.table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def lane_sequence_search(spark: SparkSession, d: str) -> DataFrame:
    return grouped.lane_sequences(*_map(spark, d))


def kmeans_mode_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grouped.ensemble_modes(world.modes(spark, d)), "x", "y", "share")


def ward_bounded(spark: SparkSession, d: str) -> DataFrame:
    return grouped.ward_scenes(_ends(spark, d))


_S = f"WITH {SQL_TRACKS}"
_SM = f"WITH {SQL_TRACKS},{SQL_MOVING}"
SQL_STATES = """
states AS (SELECT scenario_id, agent_id, t, CAST(least(floor((heading+3.141592653589793::double)/1.5707963267948966::double),3) AS BIGINT) AS state FROM moving WHERE valid),
_g AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY t) - row_number() OVER (PARTITION BY scenario_id, agent_id, state ORDER BY t) AS g FROM states),
runs AS (SELECT scenario_id, agent_id, state, min(t) AS start, max(t)+1 AS "end" FROM _g GROUP BY scenario_id, agent_id, state, g)"""
SQL_ENDS = "ends AS (SELECT scenario_id, agent_id, round(arg_max(x,t)-arg_min(x,t),2) AS x, round(arg_max(y,t)-arg_min(y,t),2) AS y FROM tracks WHERE valid GROUP BY 1,2)"
_R = f"{_SM},{SQL_STATES}"
_E = f"{_S},{SQL_ENDS}"


def _assign(c: str, out: str) -> str:
    return f"{out} AS (SELECT scenario_id, agent_id, x, y, k, round({sql_norm('x-cx','y-cy')},6) AS dist FROM ends, {c} QUALIFY row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY round({sql_norm('x-cx','y-cy')},6), k)=1)"


def _means(a: str, out: str) -> str:
    return f"{out} AS (SELECT k, sum(CAST(round(x*100) AS BIGINT))/count(*)/100.0::double AS cx, sum(CAST(round(y*100) AS BIGINT))/count(*)/100.0::double AS cy FROM {a} GROUP BY 1)"


SQL_ANOMALY = f"""
_hq AS (SELECT scenario_id, agent_id, t, least(CAST(floor((heading + 3.141592653589793::double)/1.5707963267948966::double) AS BIGINT), 3) AS state FROM moving WHERE valid),
_hg AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY t) - row_number() OVER (PARTITION BY scenario_id, agent_id, state ORDER BY t) AS g FROM _hq),
_hr AS (SELECT scenario_id, agent_id, state, max(t) + 1 - min(t) AS len FROM _hg GROUP BY scenario_id, agent_id, state, g HAVING max(t) + 1 - min(t) >= 5),
_ha AS (SELECT scenario_id, agent_id, sum(abs(state-1.5::double)*len*len)/sum(len)/sqrt(303.0::double) AS a FROM _hr GROUP BY 1,2),
anomalies AS (SELECT scenario_id, agent_id, {sql_r4('coalesce(a,0)','anomaly')} FROM (SELECT DISTINCT scenario_id, agent_id FROM tracks) LEFT JOIN _ha USING (scenario_id, agent_id))"""

QUERIES = {
    "state_runs": (state_runs, f"{_R} SELECT * FROM runs"),
    "segment_bounds": (segment_bounds, f"""{_R}, c AS (SELECT scenario_id, agent_id, start AS c FROM runs UNION SELECT scenario_id, agent_id, max(t) FROM states GROUP BY 1,2)
        SELECT scenario_id, agent_id, c AS start, lead(c) OVER w + (lead(c,2) OVER w IS NULL)::int AS "end" FROM c WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY c) QUALIFY lead(c) OVER w IS NOT NULL"""),
    "primitive_stats": (primitive_stats, f'{_R}, n AS (SELECT scenario_id, agent_id, count(*) AS n_prims, sum("end"-start) AS steps FROM runs GROUP BY 1,2) SELECT n_prims, count(*) AS n_agents, {sql_r4("sum(steps)/sum(n_prims)","mean_length")} FROM n GROUP BY 1'),
    "nearest_centroid": (nearest_centroid, f"{_E}, c AS (SELECT label AS k, sum(CAST(round(embedding[1]::double*1000000) AS BIGINT))/count(*)/1000.0::double AS cx, sum(CAST(round(embedding[2]::double*1000000) AS BIGINT))/count(*)/1000.0::double AS cy FROM embeddings GROUP BY 1), {_assign('c','a')} SELECT agent_id, k, dist FROM a"),
    "lloyd_fixed_iters": (lloyd_fixed_iters, f"{_E}, c0 AS (SELECT CAST(row_number() OVER (ORDER BY agent_id)-1 AS INT) AS k, x AS cx, y AS cy FROM ends ORDER BY agent_id LIMIT 4), {_assign('c0','a0')}, {_means('a0','c1')}, {_assign('c1','a1')}, {_means('a1','c2')}, {_assign('c2','a2')} SELECT agent_id, k, dist FROM a2"),
    "anomaly_weighted": (anomaly_weighted, f"""{_R}, l AS (SELECT scenario_id, agent_id, "end"-start AS len, abs(state-1.5::double)*("end"-start) AS d FROM runs WHERE "end"-start >= 5), g AS (SELECT scenario_id, agent_id, sum(d*len)/sum(len)/sqrt(303.0::double) AS a FROM l GROUP BY 1,2)
        SELECT e.scenario_id, e.agent_id, {sql_r4('coalesce(a,0)','anomaly')} FROM (SELECT DISTINCT scenario_id, agent_id FROM tracks) e LEFT JOIN g USING (scenario_id, agent_id)"""),
    "pair_anomaly": (pair_anomaly, f"""{_R}, l AS (SELECT scenario_id, agent_id, "end"-start AS len, abs(state-1.5::double)*("end"-start) AS d FROM runs WHERE "end"-start >= 5), g AS (SELECT scenario_id, agent_id, sum(d*len)/sum(len)/sqrt(303.0::double) AS a FROM l GROUP BY 1,2),
        e AS (SELECT scenario_id, agent_id, {sql_r4('coalesce(a,0)','a')} FROM (SELECT DISTINCT scenario_id, agent_id FROM tracks) LEFT JOIN g USING (scenario_id, agent_id))
        SELECT x.scenario_id, x.agent_id AS i, y.agent_id AS j, greatest(x.a, y.a) AS anomaly FROM e x JOIN e y ON x.scenario_id=y.scenario_id AND x.agent_id<y.agent_id"""),
    "medoid": (medoid, f"{_E}, m AS (SELECT a.scenario_id, a.agent_id, round(avg({sql_norm('a.x-b.x','a.y-b.y')}),6) AS mean_d FROM ends a JOIN ends b ON a.scenario_id=b.scenario_id AND a.agent_id<>b.agent_id GROUP BY 1,2) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY mean_d, agent_id)=1"),
    "silhouette_from_distance": (silhouette_from_distance, f"""{_E}, l AS (SELECT *, CASE WHEN agent_id%10<=5 THEN 0 WHEN agent_id%10<=7 THEN 1 ELSE 2 END AS k FROM ends), m AS (SELECT a.agent_id, a.k, b.k AS ok, avg({sql_norm('a.x-b.x','a.y-b.y')}) AS m FROM l a JOIN l b ON a.scenario_id=b.scenario_id AND a.agent_id<>b.agent_id GROUP BY 1,2,3),
        s AS (SELECT agent_id, min(m) FILTER (k=ok) AS a, min(m) FILTER (k<>ok) AS b FROM m GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL) SELECT agent_id, {sql_r4('a','a')}, {sql_r4('b','b')}, {sql_r4('(b-a)/nullif(greatest(a,b),0)','s')} FROM s"""),
    "knn_vote": (knn_vote, f"""{_E}, n AS (SELECT a.scenario_id, a.agent_id, b.agent_id%3 AS label FROM ends a JOIN ends b ON a.scenario_id=b.scenario_id AND a.agent_id<>b.agent_id QUALIFY row_number() OVER (PARTITION BY a.agent_id ORDER BY round({sql_norm('a.x-b.x','a.y-b.y')},6), b.agent_id) <= 5),
        v AS (SELECT scenario_id, agent_id, label, count(*) AS c FROM n GROUP BY 1,2,3) SELECT scenario_id, agent_id, label FROM v QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY c DESC, label)=1"""),
    "procrustes_rmsd": (procrustes_rmsd, f"""{_S}, s AS (SELECT scenario_id, agent_id, t, x-avg(x) OVER p AS x, y-avg(y) OVER p AS y FROM tracks WINDOW p AS (PARTITION BY scenario_id, agent_id)),
        q AS (SELECT s.scenario_id, s.agent_id, sum(s.x*r.y-s.y*r.x) AS c, sum(s.x*r.x+s.y*r.y) AS d, sum(s.x*s.x+s.y*s.y+r.x*r.x+r.y*r.y) AS z, count(*) AS n FROM s JOIN s r ON r.agent_id=1 AND r.scenario_id=0 AND r.t=s.t GROUP BY 1,2)
        SELECT scenario_id, agent_id, {sql_r4('sqrt(greatest(0, z-2*sqrt(c*c+d*d))/n)','rmsd')} FROM q"""),
    "coverage_by_type": (coverage_by_type, f"""WITH {SQL_TRACKS},{SQL_MOVING},{SQL_POINTS},{SQL_LANES},{SQL_NEAR}, g AS (SELECT m.agent_id, avg(speed)<0.25 AS stationary, count(*) FILTER (valid)/count(*) AS v, count(n.d)/count(*) AS l FROM moving m LEFT JOIN near n ON n.scenario_id=m.scenario_id AND n.agent_id=m.agent_id AND n.t=m.t AND n.rank=1 AND n.d<=5 GROUP BY 1)
        SELECT CASE WHEN agent_id%10<=5 THEN 'TYPE_VEHICLE' WHEN agent_id%10<=7 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_CYCLIST' END AS object_type, stationary, count(*) AS n, {sql_r4('avg(v)','valid')}, {sql_r4('avg(l)','lane')} FROM g GROUP BY 1,2"""),
    "mask_reconstruction": (mask_reconstruction, f"""{_SM}, v AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY scenario_id, agent_id) AS n FROM moving WHERE valid),
        r AS (SELECT v.*, tenths, rn*10 <= n*(10-tenths) AS kept FROM v, (VALUES (3),(6),(9)) z(tenths)), l AS (SELECT scenario_id, agent_id, tenths, max(t) AS lt, arg_max(x,t) AS lx, arg_max(y,t) AS ly, arg_max(vx,t) AS lvx, arg_max(vy,t) AS lvy FROM r WHERE kept GROUP BY 1,2,3)
        SELECT tenths, count(*) AS n, {sql_r4(f"avg({sql_norm('x-(lx+lvx*((t-lt)*0.1::double))','y-(ly+lvy*((t-lt)*0.1::double))')})",'mean_error')} FROM r JOIN l USING (scenario_id, agent_id, tenths) WHERE NOT kept GROUP BY 1"""),
    "forecast_error": (forecast_error, f"""{_SM}, f AS (SELECT a.scenario_id, a.agent_id, b.t, {sql_norm('b.x-(a.x+a.vx*((b.t-10)*0.1::double))','b.y-(a.y+a.vy*((b.t-10)*0.1::double))')} AS e FROM moving a JOIN moving b ON a.scenario_id=b.scenario_id AND a.agent_id=b.agent_id AND a.t=10 AND a.valid AND b.valid AND b.t>10)
        SELECT scenario_id, agent_id, {sql_r4('avg(e)','ade')}, {sql_r4('arg_max(e,t)','fde')} FROM f GROUP BY 1,2"""),
    "road_frame_descriptors": (road_frame_descriptors, f"""WITH {SQL_TRACKS},{SQL_MOVING},{SQL_POINTS},{SQL_LANES},{SQL_NEAR},{SQL_SEG},{SQL_ROAD}, d AS (SELECT scenario_id, agent_id, t, {sql_norm('x-(ax+least(greatest(u0,0),1)*(bx-ax))','y-(ay+least(greatest(u0,0),1)*("by"-ay))')} AS d FROM _ru)
        SELECT m.scenario_id, count(DISTINCT CASE WHEN m.agent_id%10<=5 THEN m.agent_id END) AS n_vehicle, count(DISTINCT CASE WHEN m.agent_id%10 IN (6,7) THEN m.agent_id END) AS n_pedestrian, count(DISTINCT CASE WHEN m.agent_id%10>=8 THEN m.agent_id END) AS n_cyclist,
        {sql_r4('max(d)','max_d')}, {sql_r4('avg(speed)','mean_speed')}, {sql_r4('stddev_pop(speed)','std_speed')}, {sql_r4('max(speed)','max_speed')} FROM moving m JOIN d ON d.scenario_id=m.scenario_id AND d.agent_id=m.agent_id AND d.t=m.t GROUP BY 1"""),
    "change_points_cubic": (change_points_cubic, None),
    "lane_sequence_search": (lane_sequence_search, None),
    "kmeans_mode_ensemble": (kmeans_mode_ensemble, None),
    "ward_bounded": (ward_bounded, None),
    "kmeans_endpoints": (kmeans_endpoints, None),
    "pca_variance": (pca_variance, None),
    "stream_available_now": (stream_available_now, "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'"),
    "event_sessions": (event_sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY 1,2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1"""),
}
