"""Operators on tiny frames with values computed by hand or with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry as g
from scenelake.operators import kinematics as k
from scenelake.operators import lanes as ln
from scenelake.operators import pairs as p
from scenelake.operators import predictions as pr
from scenelake.operators import scoring as sc
from scenelake.plans.lanes import best_lane
from scenelake.sources import world

TRACK = "scenario_id long, agent_id long, t int, x double, y double, valid boolean"


@pytest.fixture
def track(spark):
    def build(*agents, valid=lambda a, t: True):
        rows = [(0, a, t, float(x), float(y), valid(a, t)) for a, path in enumerate(agents) for t, (x, y) in enumerate(path)]
        return spark.createDataFrame(rows, TRACK)

    return build


def one(df, expr):
    return df.sparkSession.range(1).select(expr).first()[0]


def test_constant_speed(track):
    rows = k.kinematics(track([(i, 0) for i in range(5)])).orderBy("t").collect()
    assert all(r.speed == pytest.approx(10) and r.acc_x == pytest.approx(0) and r.jerk_x == pytest.approx(0) for r in rows)


def test_gradient_equals_numpy(track):
    path = np.random.default_rng(0).normal(size=(12, 2)).cumsum(0)
    rows = k.kinematics(track(path)).orderBy("t").collect()
    v = np.array([[r.vx, r.vy] for r in rows])
    assert np.allclose(v[1:], np.diff(path, axis=0) * 10) and np.allclose(v[0], v[1])
    acc = np.gradient(v[:, 0], 0.1)
    assert np.allclose([r.acc_x for r in rows], acc) and np.allclose([r.jerk_x for r in rows], np.gradient(acc, 0.1))


def test_waiting_period(track):
    path = [(0, 0), (1, 0), (1.1, 0), (1.2, 0), (3, 0)]
    (r,) = k.waiting_periods(track(path)).collect()
    assert (r.start, r.n, r.x) == (1, 2, 1.0) and r.duration == pytest.approx(0.2)


def test_interpolation_and_extrapolation(track):
    t = track([(2 * i, 0) for i in range(8)], valid=lambda a, i: i in (1, 2, 5))
    got = [r.fx for r in k.interpolate(t).orderBy("t").collect()]
    assert got == pytest.approx([2, 2, 4, 6, 8, 10, 12, 14])


def test_collision_and_crossing(track):
    a, b = [(i, 0) for i in range(5)], [(2, i - 2) for i in range(5)]
    assert p.collisions(track(a, b)).first().first_t == 2
    late = [(2, i - 3.5) for i in range(5)]
    assert p.collisions(track(a, late)).count() == 0
    cross = {r.ti: r.tj for r in p.crossings(track(a, late)).collect()}
    assert cross[2] == 3  # (2, 0) meets (2, -0.5)


def test_status_codes(spark, track):
    still, far = [(0, 0)] * 4, [(100 + i, 0) for i in range(4)]
    t = track(still, [(3, 0)] * 4, far, [(i, 9) for i in range(4)])
    got = {(r.i, r.j): r.status for r in p.status(k.with_motion(t)).collect()}
    assert got[0, 1] == "stationary" and got[0, 2] == "too_far" and got[0, 3] == "ok"
    none = track(still, far, valid=lambda a, i: (i < 2) == (a == 0))
    assert p.status(k.with_motion(none)).first().status == "no_overlap"


def test_following(track):
    lead, behind = [(10 + i, 0) for i in range(3)], [(2 * i, 0) for i in range(3)]
    moving = k.with_motion(track(lead, behind)).withColumn("length", F.lit(2.0))
    r = p.following(moving).where("t = 1").first()
    assert r.thw == pytest.approx(9 / (20 + 1e-4)) and r.ttc == pytest.approx(7 / 10) and r.drac == pytest.approx(100 / 18)


def test_road_frame_round_trip(spark):
    pts = [(0, i, *xy) for i, xy in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])]
    points = spark.createDataFrame(pts, "lane_id long, pt int, x double, y double")
    seg = ln.segments(points)
    places = spark.createDataFrame([(0, 1, 3.0, 1.0), (0, 2, 9.0, 6.0), (0, 3, -2.0, 1.0)], "lane_id long, k int, x double, y double")
    road = ln.to_road(places, seg, ["k"])
    got = {r.k: (r.s, r.d) for r in road.collect()}
    assert got[1] == pytest.approx((3, 1)) and got[2] == pytest.approx((16, 1)) and got[3][0] == 0
    assert {r.k for r in ln.to_road(places, seg, ["k"], clamp=False).collect()} == {1, 2}
    back = {r.k: (r.cx, r.cy) for r in ln.to_cartesian(road, seg, ["k"]).collect()}
    assert back[1] == pytest.approx((3, 1)) and back[2] == pytest.approx((9, 6))


def test_nearest_lane_projects(spark, track):
    points = spark.createDataFrame([(5, 0, 0.0, 0.0), (5, 1, 10.0, 0.0), (6, 0, 0.0, 4.0), (6, 1, 10.0, 4.0)], "lane_id long, pt int, x double, y double")
    lanes = spark.createDataFrame([(5, 0), (6, 0)], "lane_id long, map_id long")
    here = track([(5, 1)])
    maps = here.select("scenario_id").distinct().selectExpr("scenario_id", "0L AS map_id")
    r = ln.nearest(here, maps, lanes, points, 1).first()
    near = ln.near(here, maps, lanes, points).where("rank = 1").first()
    assert (near.lane_id, near.d) == (r.lane_id, r.d)
    assert (r.lane_id, r.d) == (5, 1.0)


def test_best_lane_averages_over_all_steps(spark, tmp_path):
    # one agent, two steps; 10,001 lanes between them, and lane 0 near the second step but far from the first
    events = [(1, 1, 1, "view", 1.00, '{"k": 50}'), (2, 2, 1, "view", 1.99, '{"k": 50}')]
    events = spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    place = F.when(F.col("id") == 0, 0.31).otherwise(0.25).cast("float")
    lane = F.concat(F.array(place, F.lit(0.1).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), 62))
    lanes = spark.range(10_002).select((F.col("id") * 15).alias("vec_id"), lane.alias("embedding"), F.lit(0).alias("label"))
    lanes.write.parquet(f"{tmp_path}/embeddings.parquet")
    (r,) = best_lane(spark, str(tmp_path)).collect()
    assert (r.lane_id, r.sim) == (15, pytest.approx(1 / (0.495 + 0.495), abs=1e-4))  # distance and shape


def test_nms_picks_and_ties(spark):
    rows = [(1, i, 0, s, x, 0.0) for i, (s, x) in enumerate([(5.0, 0.0), (4.0, 0.5), (3.0, 9.0), (3.0, 20.0)])]
    modes = spark.createDataFrame(rows, "object_id long, mode int, model_id long, score double, x double, y double")
    assert [r["mode"] for r in pr.nms(modes, 2.5, 3).orderBy("rank").collect()] == [0, 2, 3]
    assert [r["mode"] for r in pr.nms(modes, 100.0, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_percentile_split_is_strict(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "scenario_id long, score double")
    got = sc.score_split(scores)
    assert got.first().limit == pytest.approx(8.2)
    assert {r.scenario_id for r in got.where("split = 'test'").collect()} == {9, 10}


def test_scene_score(spark):
    rows = [(0, 2.0, None, True), (0, 4.0, 1.0, False)]
    got = sc.scene_score(spark.createDataFrame(rows, "scenario_id long, score double, d double, is_target boolean"))
    assert got.first().score == pytest.approx((2 + 2) / (1 + 1))


@pytest.mark.parametrize("b,meet", [((0, 1, 1, 0), True), ((1, 1, 2, 0), True), ((2, 2, 3, 3), False), ((5, 0, 6, 1), False)])
def test_segments_meet(spark, b, meet):
    lit = [F.lit(float(v)) for v in (0, 0, 1, 1, *b)]
    assert one(spark.range(1), g.segments_meet(*lit)) is (meet and b != (1, 1, 2, 0) or b == (1, 1, 2, 0))


def test_angles(spark):
    r = spark.range(1)
    assert one(r, g.wrap(F.lit(math.pi))) == pytest.approx(-math.pi)
    assert one(r, g.heading_difference(F.lit(170.0), F.lit(-170.0))) == pytest.approx(20)
    assert one(r, g.nms_radius(F.lit(30.0))) == pytest.approx(3.25) and one(r, g.inverse(F.lit(0.0))) == float("inf")


def test_one_sided_scores_are_put_on_pairs(spark):
    """i completed against j reported: side0 is of the smaller id; each agent counts its own side."""
    rows = [(1, 2, 5, 3.0), (1, 5, 2, 7.0), (1, 5, 9, 1.0)]
    ordered = spark.createDataFrame(rows, "scenario_id long, i long, j long, score double")
    sides = {(r.i, r.j): (r.side0, r.side1) for r in sc.rekeyed(ordered, "score").collect()}
    assert sides == {(2, 5): (3.0, 7.0), (5, 9): (1.0, 0.0)}
    pairs = spark.createDataFrame([(1, 2, 5, 4.0, 2.0, 6.0, 3.0, 7.0, 1.5, 1.0)], "scenario_id long, i long, j long, gt double, fe double, lim double, side0 double, side1 double, d_gt double, d_fe double")
    got = {r.agent_id: (r.gt, r.fe, r.asym, r.combined, r.asym_combined, r.fe_lim) for r in sc.pair_variants(pairs).collect()}
    assert got == {2: (4.0, 2.0, 3.0, 4.0, 4.0, 6.0), 5: (4.0, 2.0, 7.0, 4.0, 7.0, 6.0)}


def test_percentiles_equal_numpy(spark):
    import numpy as np

    for values in ([1.0], [3.0, 1.0], [2.0] * 7, np.random.default_rng(1).normal(size=500).round(1).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = sc.percentiles(df, "v", {"a": 0.005, "b": 0.5, "c": 0.8, "d": 1.0}).first()
        assert np.allclose(list(got), np.percentile(values, [0.5, 50, 80, 100]))


def test_an_agent_goes_on_in_another_scenario(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2020, 1, 1)
    rows = [(i, 11, start + timedelta(seconds=i), "view", 0.5, '{"k": 60}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    t = world.tracks(spark, f"file://{tmp_path}")
    n = {r.scenario_id: r["count"] for r in t.groupBy("scenario_id").count().collect()}
    assert n == {1: 91, 1 + world.LATER: 91, 1 + 2 * world.LATER: 18}
    first = t.where("t = 0").select("x", "y").distinct().collect()
    assert len(first) == 1


def test_misses_in_the_frame_of_the_true_heading(spark):
    """Along the heading six metres are allowed at eight seconds and full speed, across it three."""
    from scenelake.operators import trajectories as tr

    truth = [(0.0, 6.0 * i, True) for i in range(16)]  # upwards at 12 m/s
    def modes(dx, dy):
        return [(0.0 + dx, 6.0 * i + dy) for i in range(16)]
    paths = spark.createDataFrame([(1, m, 1.0 / (m + 1), modes(*e)) for m, e in enumerate([(0, 5.9), (0, 6.1), (2.9, 0), (3.1, 0)])], "object_id long, mode int, score double, path array<struct<x: double, y: double>>")
    truths = spark.createDataFrame([(1, "TYPE_VEHICLE", truth)], "object_id long, object_type string, path array<struct<x: double, y: double, valid: boolean>>")
    found = tr.errors(paths, truths)
    got = {r.mode: r.miss for r in tr.misses(found).where("seconds = 8").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True}
    assert abs(tr.least_errors(found).first().ade - 2.9) < 1e-6
