"""Registered queries: model samples, road-frame scenes, losses, per-type clusters, descriptors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import dist, heading_difference, rotate, round_, segments_meet
from scenelake.operators import grouped
from scenelake.operators import kinematics as k
from scenelake.operators import lanes as ln
from scenelake.operators import pairs as pr
from scenelake.operators import primitives as pm
from scenelake.operators import scoring as sc
from scenelake.operators import shapes as sh
from scenelake.plans.helpers import r4, rounded, sql_norm, sql_r4
from scenelake.plans.kinematics import SQL_MOVING, agent_centric
from scenelake.plans.lanes import SQL_NEAR, SQL_SEG, _at, _in_lane, _map, polyline_centroid, topk_polylines
from scenelake.plans.pairs import SQL_CP, conflict_points, sql_meet
from scenelake.plans.shapes import _SUMS
from scenelake.plans.trajectories import _placed
from scenelake.sources import world
from scenelake.sources.shared import handed_on
from scenelake.sources.world import SQL_LANES, SQL_MODES, SQL_PATHS, SQL_POINTS, SQL_TRACKS, SQL_TRUTHS

A = k.AGENT


def _moving(spark: SparkSession, d: str) -> DataFrame:
    return world.with_type(k.with_motion(world.tracks(spark, d)))


def _frame(moving: DataFrame) -> DataFrame:
    """Place and heading now of each scene's first valid target."""
    now = moving.where((F.col("t") == world.NOW) & F.col("is_target") & F.col("valid"))
    first = now.groupBy("scenario_id").agg(F.min(F.struct("agent_id", "x", "y", "heading")).alias("f"))
    return first.select("scenario_id", F.col("f.agent_id").alias("ego"), F.col("f.x").alias("cx"), F.col("f.y").alias("cy"), F.col("f.heading").alias("ch"))


def agent_channels(spark: SparkSession, d: str) -> DataFrame:
    """The 29 channels of each agent's history in the frame of the scene's target: place and size (6),
    type, target and ego (5), step as one of eleven and in seconds (12), heading (2), velocity (2) and
    acceleration (2)."""
    m = _moving(spark, d)
    acc = m.withColumns({f"a{c}": F.coalesce(F.col(f"v{c}") - F.lag(f"v{c}").over(k.steps()), F.lit(0.0)) * 10 for c in "xy"})
    own = acc.where((F.col("t") <= world.NOW) & F.col("valid")).join(_frame(m), "scenario_id")
    turn = -F.col("ch")
    x, y = rotate(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), turn)
    vx, vy = rotate(F.col("vx"), F.col("vy"), turn)
    ax, ay = rotate(F.col("ax"), F.col("ay"), turn)
    flag = lambda c, n: c.cast("int").alias(n)
    return own.select(
        *A, "t", r4("x", x), r4("y", y), F.lit(0.0).alias("z"), "length", "width", F.lit(1.5).alias("height"),
        *(flag(F.col("object_type") == f"TYPE_{n.upper()}", f"is_{n}") for n in ("vehicle", "pedestrian", "cyclist")),
        flag(F.col("is_target"), "target"), flag(F.col("agent_id") == F.col("ego"), "is_ego"),
        *(flag(F.col("t") == i, f"step{i}") for i in range(11)), (F.col("t") * 0.1).alias("seconds"),
        r4("sin", F.sin(F.col("heading") - F.col("ch"))), r4("cos", F.cos(F.col("heading") - F.col("ch"))),
        r4("vx", vx), r4("vy", vy), r4("ax", ax), r4("ay", ay),
    )


def agent_sample(spark: SparkSession, d: str) -> DataFrame:
    """Agents with a valid history: last place, valid steps before and after now."""
    t = world.tracks(spark, d)
    past, future = F.col("valid") & (F.col("t") <= world.NOW), F.col("valid") & (F.col("t") > world.NOW)
    last = F.max(F.when(past, F.struct("t", "x", "y")))
    s = t.groupBy(*A).agg(F.count_if(past).alias("n_past"), F.count_if(future).alias("n_future"), last.alias("p")).where("n_past > 0")
    return s.select(*A, "n_past", "n_future", r4("x", F.col("p.x")), r4("y", F.col("p.y")))


def map_sample(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of the polylines nearest to each target's way, in its frame."""
    m = _moving(spark, d).where((F.col("t") == world.NOW) & F.col("is_target"))
    frame = m.select(*A, F.col("x").alias("ox"), F.col("y").alias("oy"), "heading")
    near = topk_polylines(spark, d).join(frame, A).join(polyline_centroid(spark, d), "lane_id")
    x, y = rotate(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"), -F.col("heading"))
    return near.select(*A, "rank", "lane_id", r4("x", x), r4("y", y))


def scene_sample(spark: SparkSession, d: str) -> DataFrame:
    """Each target's sample: agents in its frame and how far they reach, polylines chosen."""
    c = agent_centric(spark, d).groupBy("scenario_id", "target_id").agg(
        F.countDistinct("agent_id").alias("n_agents"), F.count("*").alias("n_steps"), F.max(F.abs("x")).alias("reach")
    )
    n = topk_polylines(spark, d).groupBy("scenario_id", F.col("agent_id").alias("target_id")).agg(F.count("*").alias("n_lanes"))
    return c.join(n, ["scenario_id", "target_id"])


def both_frames(spark: SparkSession, d: str) -> DataFrame:
    """Steps with their places in the plane and on the lane, and a weight of a tenth of the speed."""
    road = ln.to_road(_at(spark, d), ln.segments(world.lane_points(spark, d)), [*A, "t"])
    m = k.with_motion(world.tracks(spark, d)).select(*A, "t", "speed")
    return road.join(m, [*A, "t"]).select(*A, "t", r4("x"), r4("y"), r4("s"), r4("d"), r4("weight", F.col("speed") / 10))


def _target_lane(spark: SparkSession, d: str) -> DataFrame:
    """The lane of each scene's first valid target: the one nearest on average over its history."""
    t, maps, lanes, points = _map(spark, d)
    ego = _frame(_moving(spark, d)).select("scenario_id", F.col("ego").alias("agent_id"))
    history = t.where(F.col("t") <= world.NOW).join(ego, A, "left_semi")
    sim = ln.similarity(ln.distances(history, maps, lanes, points))
    best = sim.groupBy("scenario_id").agg(F.max(F.struct("sim", (-F.col("lane_id")).alias("l"))).alias("b"))
    return best.select("scenario_id", (-F.col("b.l")).alias("lane_id"))


def tracks_on_target_lane(spark: SparkSession, d: str) -> DataFrame:
    """All tracks of a scene on its target's lane: s and d, their changes, and the heading against the
    lane's segment."""
    m = k.with_motion(world.tracks(spark, d)).where("valid").join(_target_lane(spark, d), "scenario_id")
    segments = ln.segments(world.lane_points(spark, d))
    road = ln.to_road(m, segments, [*A, "t", "heading"])
    own = road.join(segments.select("lane_id", "seg", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("way")), ["lane_id", "seg"])
    w = k.steps()
    return own.select(
        *A, "t", "lane_id", r4("s"), r4("d"), r4("ds", F.coalesce(F.col("s") - F.lag("s").over(w), F.lit(0.0))), r4("dd", F.coalesce(F.col("d") - F.lag("d").over(w), F.lit(0.0))),
        r4("against", heading_difference(F.degrees("way"), F.degrees("heading"))),
    )


def map_on_target_lane(spark: SparkSession, d: str) -> DataFrame:
    """Polylines' centroids and signals' stop points of a scene on its target's lane."""
    lanes = world.lanes(spark, d)
    target = _target_lane(spark, d)
    maps = world.scene_maps(world.tracks(spark, d)).join(target, "scenario_id").select("scenario_id", "map_id", F.col("lane_id").alias("own"))
    poly = polyline_centroid(spark, d).join(lanes.select("lane_id", "map_id"), "lane_id").select("map_id", F.lit("polyline").alias("kind"), F.col("lane_id").alias("feature_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    signal = conflict_points(spark, d).select("map_id", F.lit("signal").alias("kind"), F.col("cp_id").alias("feature_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    places = maps.join(poly.unionByName(signal), "map_id").withColumnRenamed("own", "lane_id")
    road = ln.to_road(places, ln.segments(world.lane_points(spark, d)), ["scenario_id", "kind", "feature_id"])
    return road.groupBy("scenario_id", "kind").agg(F.count("*").alias("n"), r4("least_d", F.min(F.abs(round_("d", 6)))), r4("max_s", F.max(round_("s", 6))))


def box_corners(spark: SparkSession, d: str) -> DataFrame:
    """The four corners of each agent's box now."""
    m = _moving(spark, d).where(F.col("t") == world.NOW)
    signs = F.explode(F.array(*(F.struct(F.lit(i).alias("corner"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1)))))).alias("g")
    rows = m.select(*A, "x", "y", "heading", "length", "width", signs)
    x, y = rotate(F.col("g.a") * F.col("length") / 2, F.col("g.b") * F.col("width") / 2, F.col("heading"))
    return rows.select(*A, "g.corner", r4("x", F.col("x") + x), r4("y", F.col("y") + y))


def gaussian_kl(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of each object's best mode from the mean of its modes, as Gaussians of one axis."""
    m = world.modes(spark, d)
    own = m.groupBy("object_id").agg(F.avg("x").alias("mu"), (F.stddev_pop("x") + 1).alias("sigma"))
    best = m.where("mode = 0").join(own, "object_id")
    kl = F.log("sigma") + (1 + (F.col("x") - F.col("mu")) ** 2) / (2 * F.col("sigma") ** 2) - 0.5
    return best.select("object_id", r4("kl", kl))


def mode_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of the truth under each object's modes: log of the sum over modes of share times a
    round Gaussian, from the greatest term."""
    m = world.modes(spark, d).join(world.truths(spark, d), "object_id")
    share = F.log(F.col("score") / F.sum("score").over(Window.partitionBy("object_id")))
    far = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2
    rows = m.withColumn("l", share - far / 50 - F.log(F.lit(2 * np.pi * 25)))
    top = rows.withColumn("top", F.max("l").over(Window.partitionBy("object_id")))
    return top.groupBy("object_id").agg(r4("ll", F.max("top") + F.log(F.sum(F.exp(F.col("l") - F.col("top"))))))


def softplus_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Softplus of each true coordinate less five, kept within 0.1 and 10."""
    x = F.log1p(F.exp(F.col("tx") - 5))
    return world.truths(spark, d).select("object_id", r4("value", F.least(F.lit(10.0), F.greatest(F.lit(0.1), x))))


def local_attention(spark: SparkSession, d: str) -> DataFrame:
    """Attention of each object's modes over the three nearest modes of the object: weights and values."""
    m = world.modes(spark, d).select("object_id", "mode", (F.col("x") / 50).alias("a"), (F.col("y") / 10).alias("b"))
    key = m.select("object_id", F.col("mode").alias("key"), F.col("a").alias("ka"), F.col("b").alias("kb"))
    both = m.join(key, "object_id").withColumn("far", round_(dist(F.col("a"), F.col("b"), F.col("ka"), F.col("kb")), 6))
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("object_id", "mode").orderBy("far", "key"))).where("r <= 3")
    e = near.withColumn("e", F.exp(F.col("a") * F.col("ka") + F.col("b") * F.col("kb")))
    w = e.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy("object_id", "mode")))
    return w.groupBy("object_id", "mode").agg(r4("top", F.max("w")), r4("va", F.sum(F.col("w") * F.col("ka"))), r4("vb", F.sum(F.col("w") * F.col("kb"))))


def _samples(paths: DataFrame, *columns: str) -> DataFrame:
    """Paths as a row for each sample, with the sample before and a grid cell of 10 m."""
    rows = paths.select("object_id", *columns, F.floor(F.col("object_id") / 32).alias("block"), F.col("path"), F.posexplode("path").alias("k", "p"))
    before = F.when(F.col("k") > 0, F.element_at("path", F.greatest(F.col("k"), F.lit(1))))
    six = lambda c, n: [round_(c[a], 6).alias(f"{n}{a}") for a in "xy"]
    cell = [F.floor(F.col("p")[a] / 10).alias(f"g{a}") for a in "xy"]
    own = rows.select("object_id", *columns, "block", "k", "p", *six(F.col("p"), ""), *six(before, "p"), before.alias("b"), *cell)
    return own


def mode_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Modes that come near another object's true future in their block of 32, by type: within 0.1, 0.25,
    0.5 and 1 m at a common valid sample, or crossing it there.  Only samples within 10 m count, so grid
    cells of 10 m are part of the join's key."""
    types = world.truths(spark, d).select("object_id", "object_type")
    mine = _samples(_placed(world.mode_paths(world.modes(spark, d))), "mode").withColumn("o", pr.neighbours())
    mine = mine.withColumns({"gx": F.col("gx") + F.col("o.a"), "gy": F.col("gy") + F.col("o.b")})
    true = _samples(_placed(world.true_paths(world.truths(spark, d)))).where("p.valid")
    true = true.select("block", "k", "gx", "gy", F.col("object_id").alias("other"), F.col("p").alias("q"), F.coalesce("b.valid", F.lit(False)).alias("whole"), *(F.col(c).alias(f"q{c}") for c in ("x", "y", "px", "py")))
    met = mine.join(true, ["block", "k", "gx", "gy"]).where("object_id <> other")
    near = met.withColumn("d", round_(dist(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")), 6)).where("d <= 10")
    crossed = F.col("whole") & F.coalesce(segments_meet(*(F.col(c) for c in ("px", "py", "x", "y", "qpx", "qpy", "qx", "qy"))), F.lit(False))
    pairs = near.groupBy("object_id", "mode", "other").agg(F.min("d").alias("d"), F.max(crossed).alias("x")).join(types, "object_id")
    hits = {c: (F.col("d") < c) | F.col("x") for c in (0.1, 0.25, 0.5, 1.0)}
    found = pairs.groupBy("object_type").agg(*(F.count_if(h).alias(f"c{int(c * 100)}") for c, h in hits.items()))
    n = world.modes(spark, d).join(types, "object_id").groupBy("object_type").agg(F.count("*").alias("n_modes"))
    return n.join(found, "object_type").select("object_type", "n_modes", *(f"c{c}" for c in (10, 25, 50, 100)), r4("rate", F.col("c100") / F.col("n_modes")))


def speed_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Agents of each type by mean speed: stationary, or between the percentiles of those that move."""
    v = _moving(spark, d).groupBy(*A, "object_type").agg(round_(F.avg("speed"), 6).alias("v")).withColumn("still", F.col("v") < 0.25)
    cuts = None
    for n in ("VEHICLE", "PEDESTRIAN", "CYCLIST"):
        own = v.where((F.col("object_type") == f"TYPE_{n}") & ~F.col("still")).select("v")
        row = sc.percentiles(own, "v", {"lo": 0.33, "hi": 0.66}).withColumn("object_type", F.lit(f"TYPE_{n}"))
        cuts = row if cuts is None else cuts.unionByName(row)
    b = v.join(F.broadcast(cuts), "object_type", "left")  # a row for each type
    name = F.when(F.col("still"), "stationary").when(F.col("v") <= F.col("lo"), "speed1").when(F.col("v") <= F.col("hi"), "speed2").otherwise("speed3")
    return b.groupBy("object_type", name.alias("bucket")).agg(F.count("*").alias("n"))


def scene_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """31 descriptors of each scene in the road frame: agents by type, offsets along and across the lane
    and their changes (mean, deviation, extremes), the angle to the lane, speeds, lanes and steps."""
    segments = ln.segments(world.lane_points(spark, d))
    road = ln.to_road(_at(spark, d), segments, [*A, "t"])
    way = segments.select("lane_id", "seg", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("way"))
    m = world.with_type(k.with_motion(world.tracks(spark, d)).where("valid")).select(*A, "t", "speed", "heading", "object_type")
    w = k.steps()
    rows = road.join(way, ["lane_id", "seg"]).join(m, [*A, "t"])
    rows = rows.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in ("s", "d")} | {"cos": F.cos(F.col("heading") - F.col("way")), "off": F.abs("d")})
    stats = [r4(f"{n}_{c}", f(c)) for c in ("s", "d", "ds", "dd", "speed") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    kinds = [F.countDistinct(F.when(F.col("object_type") == f"TYPE_{n.upper()}", F.col("agent_id"))).alias(f"n_{n}") for n in ("vehicle", "pedestrian", "cyclist")]
    return rows.groupBy("scenario_id").agg(
        F.countDistinct("agent_id").alias("n_agents"), *kinds, F.countDistinct("lane_id").alias("n_lanes"), F.count("*").alias("n_steps"), *stats,
        r4("mean_cos", F.avg("cos")), r4("std_cos", F.stddev_pop("cos")), r4("min_off", F.min("off")), r4("max_off", F.max("off")),
        r4("share_near", F.avg((F.col("off") <= 2.5).cast("double"))),
    )


def pair_gates(spark: SparkSession, d: str) -> DataFrame:
    """Why a pair is or isn't measured, with the gate on shared lanes between distance and heading."""
    m = _moving(spark, d)
    u = _in_lane(spark, d).select(*A, "lane_id").distinct()
    a, b = (u.select("scenario_id", "lane_id", F.col("agent_id").alias(n)) for n in "ij")
    shared = a.join(b, ["scenario_id", "lane_id"]).where("i < j").select(*pr.PAIR).distinct().withColumn("shared", F.lit(True))
    s = pr.status(m).join(shared, pr.PAIR, "left")
    passed = F.col("status").isin("heading", "ok")
    status = F.when(passed & F.col("shared").isNull(), "not_lane_sharing").otherwise(F.col("status"))
    return s.select(*pr.PAIR, status.alias("status"))


def rmsd_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Root mean square distances of a scene's tracks after centring and the best rotation."""
    s = sh.shape_sums(world.tracks(spark, d)).where("n >= 3")
    n = F.col("n")
    mid = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / n
    xx, yy, xy, yx = mid("xx", "mxi", "mxj"), mid("yy", "myi", "myj"), mid("xy", "mxi", "myj"), mid("yx", "myi", "mxj")
    size = [F.col(f"q{c}") - (F.col(f"mx{c}") ** 2 + F.col(f"my{c}") ** 2) / n for c in "ij"]
    best = F.sqrt((xx + yy) ** 2 + (xy - yx) ** 2)
    return s.select(*pr.PAIR, r4("rmsd", F.sqrt(F.greatest(F.lit(0.0), round_((size[0] + size[1] - 2 * best) / n, 6)))))


def alignment_cache(spark: SparkSession, d: str) -> DataFrame:
    """The rotation that brings each agent's track onto its scene's first, written once and read again."""
    s = sh.shape_sums(world.tracks(spark, d)).where("n >= 3").withColumn("c", F.min("i").over(Window.partitionBy("scenario_id"))).where("i = c")
    n = F.col("n")
    mid = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / n
    dot = round_(mid("xx", "mxi", "mxj") + mid("yy", "myi", "myj"), 4)
    cross = round_(mid("yx", "myi", "mxj") - mid("xy", "mxi", "myj"), 4)
    return handed_on(s.select("scenario_id", F.col("j").alias("agent_id"), "n", dot.alias("dot"), cross.alias("cross")), "alignments")


def _motions(spark: SparkSession, d: str) -> DataFrame:
    """Motion of each agent from step 10 to step 60, with its type."""
    at = lambda n: F.max(F.when(F.col("valid") & (F.col("t") == n), F.struct("x", "y")))
    e = world.tracks(spark, d).groupBy(*A).agg(at(world.NOW).alias("a"), at(60).alias("b")).where("a is not null and b is not null")
    return world.with_type(e.select(*A, *(round_(F.col(f"b.{c}") - F.col(f"a.{c}"), 2).alias(c) for c in "xy")))


def intents_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Endpoint motions in clusters of their type: fixed rounds from the first members by id."""
    found = pm.lloyd_groups(_motions(spark, d), "object_type", 4, 2, A)
    return found.select(*A, "object_type", F.col("k").cast("long").alias("k"), "dist")


def labels_of_other_splits(spark: SparkSession, d: str) -> DataFrame:
    """Clusters fitted on the train scenes name the members of the others."""
    m = _motions(spark, d)
    train = sc.hash_bucket(F.col("scenario_id")) < 80
    centres = pm.centres(pm.lloyd_groups(m.where(train), "object_type", 2, 1, A), "object_type")
    return pm.nearest_in_group(m.where(~train), centres, "object_type").select(*A, "object_type", F.col("k").cast("long").alias("k"), "dist")


def road_intents(spark: SparkSession, d: str) -> DataFrame:
    """The same for motions along and across the lane that an agent is on at step 10."""
    road = ln.to_road(_at(spark, d).where(F.col("t").isin(world.NOW, 60)), ln.segments(world.lane_points(spark, d)), [*A, "t"])
    at = lambda n: F.max(F.when(F.col("t") == n, F.struct("s", "d")))
    e = road.groupBy(*A).agg(at(world.NOW).alias("a"), at(60).alias("b")).where("a is not null and b is not null")
    m = world.with_type(e.select(*A, round_(F.col("b.s") - F.col("a.s"), 2).alias("x"), round_(F.col("b.d") - F.col("a.d"), 2).alias("y")))
    return pm.lloyd_groups(m, "object_type", 4, 2, A).select(*A, "object_type", F.col("k").cast("long").alias("k"), "dist")


def descriptor_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by standardised descriptors, in two principal components and ten clusters at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    e = scene_descriptors(spark, d).na.fill(0.0)
    names = [c for c in e.columns if c != "scenario_id"]
    z = handed_on(k.zscore(e, names).select("scenario_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names)), "descriptors")
    rows = z.select("scenario_id", array_to_vector(F.array(*(F.col(c).cast("double") for c in names))).alias("features"))
    flat = PCA(k=2, inputCol="features", outputCol="pca").fit(rows).transform(rows)
    model = KMeans(k=10, seed=42, featuresCol="pca").fit(flat)
    return model.transform(flat).select("scenario_id", F.col("prediction").alias("k"))


def normalised_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Encounters of at least five common steps at 101 equal times, both agents centred together."""
    from scenelake.operators import curves as cv

    def rows(_, curves):
        ids = list(curves)
        for a, b in zip(ids, ids[1:]):
            (ta, xa), (tb, xb) = curves[a], curves[b]
            t, ia, ib = np.intersect1d(ta, tb, return_indices=True)
            if len(t) >= 5:
                both = cv.resampled(t, np.hstack((xa[ia], xb[ib])))
                mid = (both[:, :2].mean(0) + both[:, 2:].mean(0)) / 2
                yield a, b, *(np.concatenate((mid, mid)) * -1 + both[-1]).round(4).tolist()

    return sh.per_scene(world.tracks(spark, d), rows, "i long, j long, xi double, yi double, xj double, yj double", 5)


def conflict_points_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Conflict points of lanes drawn three times as dense by Fourier resampling, as crosswalks are."""

    def dense(it):
        for pdf in it:
            out = []
            for lane, xs, ys in zip(pdf["lane_id"], pdf["xs"], pdf["ys"]):
                n = len(xs)
                both = np.fft.rfft(np.stack([np.asarray(xs, float), np.asarray(ys, float)]), axis=1)
                if n % 2 == 0:
                    both[:, -1] /= 2  # the middle frequency is shared by both sides
                fine = np.fft.irfft(both, 3 * n, axis=1) * 3
                out += [(lane, i, *p) for i, p in enumerate(fine.T.round(6).tolist())]
            yield pd.DataFrame(out, columns=["lane_id", "pt", "x", "y"])

    rows = F.sort_array(F.collect_list(F.struct("pt", "x", "y")))
    lines = world.lane_points(spark, d).groupBy("lane_id").agg(rows.alias("r"))
    fine = lines.select("lane_id", F.transform("r", lambda p: p["x"]).alias("xs"), F.transform("r", lambda p: p["y"]).alias("ys")).mapInPandas(dense, "lane_id long, pt int, x double, y double")
    return ln.intersections(fine, world.lanes(spark, d), 0.05)


def drawn_samples(spark: SparkSession, d: str) -> DataFrame:
    """Mean plus deviation times a uniform draw that depends on the object's id alone."""
    u = sc.hash_bucket(F.col("object_id"), 1 << 20) / F.lit(float(1 << 20))
    own = world.modes(spark, d).groupBy("object_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return own.select("object_id", r4("draw", F.col("m") + F.col("s") * u))


def lane_sequences_widening(spark: SparkSession, d: str) -> DataFrame:
    """Lane sequences under thresholds that double until every valid step has a lane, with the status."""
    return grouped.widening_sequences(*_map(spark, d), thresholds=(5.0, 10.0, 20.0, 40.0), reach=40.0)


_T = f"WITH {SQL_TRACKS}"
_M = f"{_T},{SQL_MOVING}"
_TYPE = "CASE WHEN {0}agent_id%10<=5 THEN 'TYPE_VEHICLE' WHEN {0}agent_id%10<=7 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_CYCLIST' END"
_EGO = "fr AS (SELECT scenario_id, agent_id AS ego, x AS cx, y AS cy, heading AS ch FROM moving WHERE t=10 AND valid AND agent_id%10<=2 QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY agent_id)=1)"
_rot = lambda x, y, a, n: f"{sql_r4(f'({x})*cos({a})-({y})*sin({a})', n[0])}, {sql_r4(f'({x})*sin({a})+({y})*cos({a})', n[1])}"
_LANES = f"{_M},{SQL_POINTS},{SQL_LANES},{SQL_NEAR},{SQL_SEG}"


def sql_road(places: str, keys: str) -> str:
    """CTE ``rd`` (keys, lane_id, seg, x, y, s, d) of places (keys, lane_id, x, y) clamped to their lane."""
    u = "least(greatest(u0,0),1)"
    px, py = f"(ax+{u}*(bx-ax))", f"(ay+{u}*(\"by\"-ay))"
    far = f"round({sql_norm('p.x-g.ax','p.y-g.ay')} + {sql_norm('p.x-g.bx','p.y-g.\"by\"')}, 6)"
    return f"""_rp AS (SELECT p.*, g.* EXCLUDE (lane_id) FROM {places} p JOIN segs g ON g.lane_id=p.lane_id WHERE g.len*g.len > 1e-8 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {far}, g.seg) = 1),
_rq AS (SELECT *, ((x-ax)*(bx-ax) + (y-ay)*("by"-ay))/(len*len) AS u0 FROM _rp),
rd AS (SELECT * EXCLUDE (s, u0), s+{u}*len AS s, (CASE WHEN (bx-ax)*(y-ay) - ("by"-ay)*(x-ax) >= 0 THEN 1.0::double ELSE -1.0::double END)*{sql_norm(f'x-{px}', f'y-{py}')} AS d, atan2("by"-ay, bx-ax) AS way FROM _rq)"""


_OWN = f"""{_LANES}, {_EGO}, hn AS (SELECT n.*, x-qx AS ox, y-qy AS oy, last(x-qx) OVER w AS lx, last(y-qy) OVER w AS ly FROM near n JOIN fr ON fr.scenario_id=n.scenario_id AND fr.ego=n.agent_id WHERE n.t <= 10
   WINDOW w AS (PARTITION BY n.scenario_id, n.agent_id, n.lane_id ORDER BY n.t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hs AS (SELECT scenario_id, lane_id, round(1/greatest(round(sum(CAST(round(d*1000000) AS BIGINT))/count(d)/1000000.0::double,8) + round(avg({sql_norm('ox-lx','oy-ly')}),8),1e-8::double),6) AS sim FROM hn GROUP BY 1,2),
tl AS (SELECT scenario_id, lane_id FROM hs QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY sim DESC, lane_id)=1)"""
_AT = "pl AS (SELECT scenario_id, agent_id, t, lane_id, x, y FROM near WHERE rank=1)"
_hd = "abs(({0} + 540.0::double) - 360*floor(({0} + 540.0::double)/360) - 180)"
_DESC = ", ".join(sql_r4(f"{f}({c})", f"{n}_{c}") for c in ("s", "d", "ds", "dd", "speed") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
_TOP = f"""c AS (SELECT lane_id, round(avg(x),8) + 0.0::double AS cx, round(avg(y),8) + 0.0::double AS cy FROM points GROUP BY 1),
q AS (SELECT m.scenario_id, m.agent_id, m.x AS ox, m.y AS oy, heading, l.lane_id, cx, cy, round({sql_norm('m.x+30*cos(heading)-cx','m.y+30*sin(heading)-cy')},4) AS d FROM moving m JOIN lanes l ON l.map_id=m.scenario_id%15 JOIN c USING (lane_id) WHERE t=10 AND agent_id%10<=2),
top8 AS (SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY d, lane_id) AS INT) AS rank FROM q QUALIFY rank <= 8)"""
_MOT = f"""{_T}, mot AS (SELECT a.scenario_id, a.agent_id, round(b.x-a.x,2) AS x, round(b.y-a.y,2) AS y, {_TYPE.format('a.')} AS object_type FROM tracks a JOIN tracks b ON a.scenario_id=b.scenario_id AND a.agent_id=b.agent_id AND a.t=10 AND b.t=60 AND a.valid AND b.valid)"""


def _seed(src: str, n: int, out: str) -> str:
    return f"{out} AS (SELECT object_type, CAST(row_number() OVER w - 1 AS INT) AS k, x AS cx, y AS cy FROM {src} WINDOW w AS (PARTITION BY object_type ORDER BY scenario_id, agent_id) QUALIFY row_number() OVER w <= {n})"


def _name(src: str, c: str, out: str) -> str:
    far = f"round({sql_norm('p.x-c.cx','p.y-c.cy')},6)"
    return f"{out} AS (SELECT p.scenario_id, p.agent_id, p.object_type, p.x, p.y, c.k, {far} AS dist FROM {src} p JOIN {c} c USING (object_type) QUALIFY row_number() OVER (PARTITION BY p.scenario_id, p.agent_id ORDER BY {far}, c.k)=1)"


def _mean(src: str, out: str) -> str:
    return f"{out} AS (SELECT object_type, k, sum(CAST(round(x*100) AS BIGINT))/count(*)/100.0::double AS cx, sum(CAST(round(y*100) AS BIGINT))/count(*)/100.0::double AS cy FROM {src} GROUP BY 1,2)"


def _rounds(src: str, n: int, rounds: int) -> str:
    out = [_seed(src, n, "c0"), _name(src, "c0", "a0")]
    for i in range(rounds):
        out += [_mean(f"a{i}", f"c{i + 1}"), _name(src, f"c{i + 1}", f"a{i + 1}")]
    return ", ".join(out)


_hb = "(((scenario_id)::BIGINT*2654435761 + 40503) % 2147483648) % 100"
_seg = "round({0}, 6)"
QUERIES = {
    "agent_channels": (agent_channels, f"""{_M}, {_EGO}, a AS (SELECT *, coalesce(vx - lag(vx) OVER w, 0)*10 AS ax, coalesce(vy - lag(vy) OVER w, 0)*10 AS ay FROM moving WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t))
        SELECT scenario_id, agent_id, t, {_rot('x-cx', 'y-cy', '-ch', 'xy')}, 0.0::double AS z, CASE WHEN agent_id%10<=5 THEN 4.5::double WHEN agent_id%10<=7 THEN 0.6::double ELSE 1.8::double END AS length,
        CASE WHEN agent_id%10<=5 THEN 2.0::double WHEN agent_id%10<=7 THEN 0.6::double ELSE 0.7::double END AS width, 1.5::double AS height, (agent_id%10<=5)::int AS is_vehicle, (agent_id%10 IN (6,7))::int AS is_pedestrian, (agent_id%10>=8)::int AS is_cyclist,
        (agent_id%10<=2)::int AS target, (agent_id=ego)::int AS is_ego, {', '.join(f'(t={i})::int AS step{i}' for i in range(11))}, t*0.1::double AS seconds, {sql_r4('sin(heading-ch)', 'sin')}, {sql_r4('cos(heading-ch)', 'cos')},
        {_rot('vx', 'vy', '-ch', ('vx', 'vy'))}, {_rot('ax', 'ay', '-ch', ('ax', 'ay'))} FROM a JOIN fr USING (scenario_id) WHERE t <= 10 AND valid"""),
    "agent_sample": (agent_sample, f"{_T}, s AS (SELECT scenario_id, agent_id, count(*) FILTER (valid AND t<=10) AS n_past, count(*) FILTER (valid AND t>10) AS n_future, arg_max(x,t) FILTER (valid AND t<=10) AS x, arg_max(y,t) FILTER (valid AND t<=10) AS y FROM tracks GROUP BY 1,2) SELECT scenario_id, agent_id, n_past, n_future, {sql_r4('x', 'x')}, {sql_r4('y', 'y')} FROM s WHERE n_past > 0"),
    "map_sample": (map_sample, f"{_M},{SQL_POINTS},{SQL_LANES},{_TOP} SELECT scenario_id, agent_id, rank, lane_id, {_rot('cx-ox', 'cy-oy', '-heading', 'xy')} FROM top8"),
    "scene_sample": (scene_sample, f"""{_M},{SQL_POINTS},{SQL_LANES},{_TOP}, f AS (SELECT scenario_id, agent_id AS target_id, x AS cx, y AS cy, -heading AS a FROM moving WHERE t=10 AND valid AND agent_id%10<=2),
        g AS (SELECT scenario_id, target_id, agent_id, {sql_r4('(x-cx)*cos(a)-(y-cy)*sin(a)', 'x')} FROM moving JOIN f USING (scenario_id) WHERE valid), n AS (SELECT scenario_id, agent_id AS target_id, count(*) AS n_lanes FROM top8 GROUP BY 1,2)
        SELECT scenario_id, target_id, count(DISTINCT agent_id) AS n_agents, count(*) AS n_steps, max(abs(x)) AS reach, any_value(n_lanes) AS n_lanes FROM g JOIN n USING (scenario_id, target_id) GROUP BY 1,2"""),
    "both_frames": (both_frames, f"{_LANES}, {_AT}, {sql_road('pl', 'p.scenario_id, p.agent_id, p.t')} SELECT r.scenario_id, r.agent_id, r.t, {sql_r4('r.x', 'x')}, {sql_r4('r.y', 'y')}, {sql_r4('s', 's')}, {sql_r4('d', 'd')}, {sql_r4('speed/10', 'weight')} FROM rd r JOIN moving m ON m.scenario_id=r.scenario_id AND m.agent_id=r.agent_id AND m.t=r.t"),
    "tracks_on_target_lane": (tracks_on_target_lane, f"""{_OWN}, pl AS (SELECT m.scenario_id, m.agent_id, m.t, m.heading, tl.lane_id, m.x, m.y FROM moving m JOIN tl USING (scenario_id) WHERE valid), {sql_road('pl', 'p.scenario_id, p.agent_id, p.t')}
        SELECT scenario_id, agent_id, t, lane_id, {sql_r4('s', 's')}, {sql_r4('d', 'd')}, {sql_r4('coalesce(s - lag(s) OVER w, 0)', 'ds')}, {sql_r4('coalesce(d - lag(d) OVER w, 0)', 'dd')}, {sql_r4(_hd.format('(degrees(heading) - degrees(way))'), 'against')} FROM rd WINDOW w AS (PARTITION BY scenario_id, agent_id ORDER BY t)"""),
    "map_on_target_lane": (map_on_target_lane, f"""{_OWN}, fe AS (SELECT map_id, 'polyline' AS kind, lane_id AS feature_id, round(avg(x),8) + 0.0::double AS x, round(avg(y),8) + 0.0::double AS y FROM points JOIN lanes USING (lane_id) GROUP BY 1,3 UNION ALL SELECT map_id, 'signal', lane_id, x, y FROM points JOIN lanes USING (lane_id) WHERE pt=0),
        pl AS (SELECT tl.scenario_id, kind, feature_id, tl.lane_id, x, y FROM tl JOIN fe ON fe.map_id = tl.scenario_id % 15), {sql_road('pl', 'p.scenario_id, p.kind, p.feature_id')}
        SELECT scenario_id, kind, count(*) AS n, {sql_r4('min(abs(round(d,6)))', 'least_d')}, {sql_r4('max(round(s,6))', 'max_s')} FROM rd GROUP BY 1,2"""),
    "box_corners": (box_corners, f"""{_M}, b AS (SELECT *, CASE WHEN agent_id%10<=5 THEN 4.5::double WHEN agent_id%10<=7 THEN 0.6::double ELSE 1.8::double END/2 AS l, CASE WHEN agent_id%10<=5 THEN 2.0::double WHEN agent_id%10<=7 THEN 0.6::double ELSE 0.7::double END/2 AS w FROM moving WHERE t=10)
        SELECT scenario_id, agent_id, corner, {sql_r4('x + a*l*cos(heading) - b*w*sin(heading)', 'x')}, {sql_r4('y + a*l*sin(heading) + b*w*cos(heading)', 'y')} FROM b, (VALUES (0,1,1),(1,1,-1),(2,-1,-1),(3,-1,1)) g(corner, a, b)"""),
    "gaussian_kl": (gaussian_kl, f"WITH {SQL_MODES}, o AS (SELECT object_id, avg(x) AS mu, stddev_pop(x)+1 AS sg FROM modes GROUP BY 1) SELECT object_id, {sql_r4('ln(sg) + (1 + (x-mu)*(x-mu))/(2*sg*sg) - 0.5::double', 'kl')} FROM modes JOIN o USING (object_id) WHERE mode=0"),
    "mode_likelihood": (mode_likelihood, f"WITH {SQL_MODES},{SQL_TRUTHS}, l AS (SELECT object_id, ln(score/sum(score) OVER (PARTITION BY object_id)) - ((x-tx)*(x-tx)+(y-ty)*(y-ty))/50 - ln(2*pi()*25) AS l FROM modes JOIN truths USING (object_id)) SELECT object_id, {sql_r4('ln(sum(exp(l)))', 'll')} FROM l GROUP BY 1"),
    "softplus_clamped": (softplus_clamped, f"WITH {SQL_TRUTHS} SELECT object_id, {sql_r4('least(10, greatest(0.1::double, ln(1+exp(tx-5))))', 'value')} FROM truths"),
    "local_attention": (local_attention, f"""WITH {SQL_MODES}, m AS (SELECT object_id, mode, x/50 AS a, y/10 AS b FROM modes), n AS (SELECT q.object_id, q.mode, q.a, q.b, k.a AS ka, k.b AS kb FROM m q JOIN m k ON q.object_id=k.object_id
        QUALIFY row_number() OVER (PARTITION BY q.object_id, q.mode ORDER BY round({sql_norm('q.a-k.a','q.b-k.b')},6), k.mode) <= 3), w AS (SELECT *, exp(a*ka+b*kb)/sum(exp(a*ka+b*kb)) OVER (PARTITION BY object_id, mode) AS w FROM n)
        SELECT object_id, mode, {sql_r4('max(w)', 'top')}, {sql_r4('sum(w*ka)', 'va')}, {sql_r4('sum(w*kb)', 'vb')} FROM w GROUP BY 1,2"""),
    "mode_collisions": (mode_collisions, f"""WITH {SQL_MODES},{SQL_TRUTHS},{SQL_PATHS}, mp AS (SELECT * REPLACE (x + (object_id % 32)*20 AS x) FROM mpaths), tp AS (SELECT * REPLACE (x + (object_id % 32)*20 AS x) FROM tpaths),
        p AS (SELECT object_id, mode, k, round(x,6) AS x, round(y,6) AS y, x AS rx, y AS ry, lag(round(x,6)) OVER w AS px, lag(round(y,6)) OVER w AS py FROM mp WINDOW w AS (PARTITION BY object_id, mode ORDER BY k)),
        t AS (SELECT object_id, k, valid, x AS rx, y AS ry, round(x,6) AS x, round(y,6) AS y, lag(round(x,6)) OVER w AS px, lag(round(y,6)) OVER w AS py, lag(valid) OVER w AS pv FROM tp WINDOW w AS (PARTITION BY object_id ORDER BY k)),
        n AS (SELECT a.object_id, a.mode, b.object_id AS other, min(CASE WHEN b.valid THEN round({sql_norm('a.rx-b.rx','a.ry-b.ry')},6) END) AS d, bool_or(coalesce(b.valid AND b.pv AND round({sql_norm('a.rx-b.rx','a.ry-b.ry')},6) <= 10 AND {sql_meet('a','b')}, false)) AS x
          FROM p a JOIN t b ON a.object_id//32=b.object_id//32 AND a.object_id<>b.object_id AND a.k=b.k GROUP BY 1,2,3),
        s AS (SELECT object_type, {', '.join(f'count(*) FILTER (d < {c}::double OR n.x) AS c{int(c * 100)}' for c in (0.1, 0.25, 0.5, 1.0))} FROM n JOIN truths USING (object_id) WHERE d <= 10 GROUP BY 1), c AS (SELECT object_type, count(*) AS n_modes FROM modes JOIN truths USING (object_id) GROUP BY 1)
        SELECT object_type, n_modes, c10, c25, c50, c100, {sql_r4('c100/n_modes', 'rate')} FROM c JOIN s USING (object_type)"""),
    "speed_buckets": (speed_buckets, f"""{_M}, v AS (SELECT scenario_id, agent_id, {_TYPE.format('')} AS object_type, round(avg(speed),6) AS v FROM moving GROUP BY 1,2), c AS (SELECT object_type, quantile_cont(v, 0.33) AS lo, quantile_cont(v, 0.66) AS hi FROM v WHERE v >= 0.25 GROUP BY 1)
        SELECT object_type, CASE WHEN v < 0.25 THEN 'stationary' WHEN v <= lo THEN 'speed1' WHEN v <= hi THEN 'speed2' ELSE 'speed3' END AS bucket, count(*) AS n FROM v LEFT JOIN c USING (object_type) GROUP BY 1,2"""),
    "scene_descriptors": (scene_descriptors, f"""{_LANES}, {_AT}, {sql_road('pl', 'p.scenario_id, p.agent_id, p.t')}, r AS (SELECT rd.scenario_id, rd.agent_id, rd.t, lane_id, s, d, s - lag(s) OVER w AS ds, d - lag(d) OVER w AS dd, speed, cos(heading-way) AS c, abs(d) AS off
          FROM rd JOIN moving m ON m.scenario_id=rd.scenario_id AND m.agent_id=rd.agent_id AND m.t=rd.t WINDOW w AS (PARTITION BY rd.scenario_id, rd.agent_id ORDER BY rd.t))
        SELECT scenario_id, count(DISTINCT agent_id) AS n_agents, count(DISTINCT CASE WHEN agent_id%10<=5 THEN agent_id END) AS n_vehicle, count(DISTINCT CASE WHEN agent_id%10 IN (6,7) THEN agent_id END) AS n_pedestrian, count(DISTINCT CASE WHEN agent_id%10>=8 THEN agent_id END) AS n_cyclist,
        count(DISTINCT lane_id) AS n_lanes, count(*) AS n_steps, {_DESC}, {sql_r4('avg(c)', 'mean_cos')}, {sql_r4('stddev_pop(c)', 'std_cos')}, {sql_r4('min(off)', 'min_off')}, {sql_r4('max(off)', 'max_off')}, {sql_r4('avg((off <= 2.5)::int::double)', 'share_near')} FROM r GROUP BY 1"""),
    "pair_gates": (pair_gates, f"""{_LANES}, g AS (SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, min({sql_norm('a.x-b.x','a.y-b.y')}) AS min_d, count(*) FILTER ({_hd.format('(degrees(b.heading) - degrees(a.heading))')} < 45) AS na FROM moving a JOIN moving b ON a.scenario_id=b.scenario_id AND a.t=b.t AND a.agent_id<b.agent_id AND a.valid AND b.valid GROUP BY 1,2,3),
        v AS (SELECT scenario_id, agent_id, avg(speed) AS v FROM moving GROUP BY 1,2), u AS (SELECT DISTINCT scenario_id, agent_id, lane_id FROM near WHERE rank=1 AND d<=5), l AS (SELECT DISTINCT a.scenario_id, a.agent_id AS i, b.agent_id AS j FROM u a JOIN u b ON a.scenario_id=b.scenario_id AND a.lane_id=b.lane_id AND a.agent_id<b.agent_id)
        SELECT a.scenario_id, a.agent_id AS i, b.agent_id AS j, CASE WHEN g.i IS NULL THEN 'no_overlap' WHEN a.v<=0.25 AND b.v<=0.25 THEN 'stationary' WHEN min_d>=50 THEN 'too_far' WHEN l.i IS NULL THEN 'not_lane_sharing' WHEN na<2 THEN 'heading' ELSE 'ok' END AS status
        FROM v a JOIN v b ON a.scenario_id=b.scenario_id AND a.agent_id<b.agent_id LEFT JOIN g ON g.scenario_id=a.scenario_id AND g.i=a.agent_id AND g.j=b.agent_id LEFT JOIN l ON l.scenario_id=a.scenario_id AND l.i=a.agent_id AND l.j=b.agent_id"""),
    "rmsd_matrix": (rmsd_matrix, f"{_SUMS}, r AS (SELECT *, sqrt((cxx+cyy)*(cxx+cyy)+(cxy-cyx)*(cxy-cyx)) AS t FROM sc WHERE n >= 3) SELECT scenario_id, i, j, {sql_r4('sqrt(greatest(0, round((qi-(mxi*mxi+myi*myi)/n + qj-(mxj*mxj+myj*myj)/n - 2*t)/n, 6)))', 'rmsd')} FROM r"),
    "alignment_cache": (alignment_cache, f"{_SUMS}, f AS (SELECT *, min(i) OVER (PARTITION BY scenario_id) AS c FROM sc WHERE n >= 3) SELECT scenario_id, j AS agent_id, n, round(cxx+cyy, 4) AS dot, round(cyx-cxy, 4) AS cross FROM f WHERE i=c"),
    "intents_by_type": (intents_by_type, f"{_MOT}, {_rounds('mot', 4, 2)} SELECT scenario_id, agent_id, object_type, CAST(k AS BIGINT) AS k, dist FROM a2"),
    "labels_of_other_splits": (labels_of_other_splits, f"{_MOT}, tr AS (SELECT * FROM mot WHERE {_hb} < 80), te AS (SELECT * FROM mot WHERE {_hb} >= 80), {_rounds('tr', 2, 1)}, {_mean('a1', 'cf')}, {_name('te', 'cf', 'af')} SELECT scenario_id, agent_id, object_type, CAST(k AS BIGINT) AS k, dist FROM af"),
    "road_intents": (road_intents, f"""{_LANES}, pl AS (SELECT scenario_id, agent_id, t, lane_id, x, y FROM near WHERE rank=1 AND t IN (10, 60)), {sql_road('pl', 'p.scenario_id, p.agent_id, p.t')},
        rm AS (SELECT a.scenario_id, a.agent_id, round(b.s-a.s,2) AS x, round(b.d-a.d,2) AS y, {_TYPE.format('a.')} AS object_type FROM rd a JOIN rd b ON a.scenario_id=b.scenario_id AND a.agent_id=b.agent_id AND a.t=10 AND b.t=60), {_rounds('rm', 4, 2)} SELECT scenario_id, agent_id, object_type, CAST(k AS BIGINT) AS k, dist FROM a2"""),
    "drawn_samples": (drawn_samples, f"WITH {SQL_MODES}, o AS (SELECT object_id, avg(x) AS m, stddev_pop(x) AS s FROM modes GROUP BY 1) SELECT object_id, {sql_r4('m + s*((((object_id)::BIGINT*2654435761 + 40503) % 2147483648) % 1048576 / 1048576.0::double)', 'draw')} FROM o"),
    "descriptor_clusters": (descriptor_clusters, None),
    "normalised_encounters": (normalised_encounters, None),
    "conflict_points_resampled": (conflict_points_resampled, None),
    "lane_sequences_widening": (lane_sequences_widening, None),
}
